"""Licence scans by canonical digest, in DataFrame functions only.

A text is brought to one form (case, punctuation, copyright statements, equivalent
spellings) and its digest is joined to the digests of known licences, which are a table of fixed size.
Single lines are looked up in the same way among short notices. Only whole texts and whole
lines match; nothing is searched for inside them.

Copyright statements. A text is cut at blank lines, after sentences (a dot after an initial or an abbreviation as in "Inc." ends
none), and before whatever looks like a copyright statement or opens a licence. A piece is a statement, and goes, if it begins with "copyright"
and a sign, a year or "by", or with a sign and a year. One that begins with a bare "copyright" or sign and a word other than those that
follow "copyright" in licences' own prose goes only where a paragraph, or what follows a licence's title, begins with a statement.
A piece of more than MOST_WORDS words is none. Line breaks count as spaces, so the form does not depend on where lines break.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that licence matching treats as equal, and the form they are brought to.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "utilisation": "utilization",
    "wilful": "willful",
}

# Whole licence texts, without their titles and copyright statements.
LICENCES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
claim that you wrote the original software. If you use this software
in a product, an acknowledgment in the product documentation would be
appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software without
specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}

# Short notices, each a line of its own.
NOTICES = {
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "All rights reserved.": "all-rights-reserved",
}

# Titles that stand above whole texts, or do not.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD License"),
    "Zlib": ("zlib License", "The zlib License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License'),
}

# SHA-256 of the canonical form of licences whose texts are long, as the licences' keepers publish them; "body" is without
# title, "terms" without what follows the end of the terms and conditions.
DIGESTS: dict[str, str] = {
    "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2": "Apache-2.0",  # whole
    "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0": "Apache-2.0",  # whole, terms
    "37599287c15c2f2ec060c3c3b55bdf69e3bc7a8aeeb9cd57e18800088789538a": "Apache-2.0",  # whole, terms, no end line
    "b35b83acee1925f4ac31d46b381bc9d2c40dc1a05e2f34d5dabb988b86b42ab6": "Apache-2.0",  # body
    "d8221a4f10c01c6fa5390685929a5ce31d7264a024162fd3dd4d805c57ce0f43": "Apache-2.0",  # body, terms
    "c876a853e3837603a39d56da29306b74786b34411bf636ce5072eb840e764cab": "Apache-2.0",  # body, terms, no end line
    "25a7ba30309c80413055e02815987e969aa310a754229bedff2d9571a496b935": "GPL-2.0",  # whole
    "34cacbc5d4c8288f220e8dfade5276e6f76704f67150b4388c9ed3e3ff88cd90": "GPL-2.0",  # whole, terms
    "f1412332f5361d2a392bb637c3844ed3a32b7d701ac0e7abacce50b34a9a3afb": "GPL-2.0",  # whole, terms, no end line
    "bf8646ace0fd9f2a0a823a971be8b861728a253f0187d867f66f539cdcbb2eb0": "GPL-2.0",  # body
    "1d3015d0c95ac4c468939c7dc58e73a3f73a8592aa68d2af118ce60740773df7": "GPL-2.0",  # body, terms
    "95aeb819f45bf6639f460cc0ba5fa250f81764324ef35320bf76fb9f99428fc1": "GPL-2.0",  # body, terms, no end line
    "861bd38e22ab70ae8dcfee80ab5d4466cb70842e09c5df25ffd0ff2f1661dd9c": "GPL-3.0",  # whole
    "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636": "GPL-3.0",  # whole, terms
    "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191": "GPL-3.0",  # whole, terms, no end line
    "c88a8f9d73c3cf82d39fd0d4da13b2e228d70dbe018749a7cbe748088b558209": "GPL-3.0",  # body
    "4868f466a3292b095d887ce2ca00548d3969efb48c33f6aced9a20c59f578c19": "GPL-3.0",  # body, terms
    "ce818a0d5cb7a9a9261f63641713dbb4ca4750284738a6c3f546d86d81a541d2": "GPL-3.0",  # body, terms, no end line
    "599d9303049b507aa89582ee08dd4ddaba298764648558e7bf8e78309807bfaa": "LGPL-2.1",  # whole
    "a6742add8db4ff9ba6917da0bd1f95927436acfd65ae81933f1e9a859d38d9fa": "LGPL-2.1",  # whole, terms
    "d00d08192018b2217de04b223449941a18a7cb07d0c025393948065a12eb0fb2": "LGPL-2.1",  # whole, terms, no end line
    "48e731def9111ee21e7b6b5dca5cb8e908fe999f7c1ef9175afef1e4c8a5e26a": "LGPL-2.1",  # body
    "7cc1b31b95dd0bec1ff475bffceda6889681862c0b7d0da58cf97d3ae0a5d4bf": "LGPL-2.1",  # body, terms
    "f0b3313d45a8a467f987a040dc16addaea95621fdaededc28db994fccd572d0e": "LGPL-2.1",  # body, terms, no end line
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",  # whole
    "13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7": "LGPL-3.0",  # body
    "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a": "MPL-2.0",  # whole
    "c0f855aacb6ac1c86bcdd1334db61014d14898798ae14888fea5446cbb9d32e3": "MPL-2.0",  # body
    "4be4a6251869e153404f424bbd1c116ada60f8969d5610b406e2a430e206b0bc": "MPL-1.1",  # whole
    "6550c725b3bd935f0832a74031b8ef99b5930f069b3ae5e5af548494db10b47c": "MPL-1.1",  # body
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",  # whole
    "a142ae38742c8c4c35f5fa19e0a40ebfa60fc38535daf9c570ca3d7e012e1e32": "CC0-1.0",  # body
    "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702": "Artistic-1.0-Perl",  # whole
    "4eaaa9e33aeef0af0ff83ab5edac0ad421a1da9cc861c564630460107b4b772c": "Artistic-1.0-Perl",  # body
    "d4786b88185d360e9d5914c2ecdeefce618d6bf3eeb60095ae5e1a3fd91c67cd": "GFDL-1.3",  # whole
    "2837649fc69f2b78b1c73c4bef637687dc74a9381faed9cf7df7eef537d330c0": "GFDL-1.3",  # body
}

YEAR = r"[\[<{(]?(?:(?:19|20)[0-9][0-9]|year|yyyy)"
SIGN = r"(?:\(c\)|©)"
GAP = r"[ \t\r\n]"
#: Where a word of ASCII letters begins; then what pieces begin with: what may be a copyright statement, and the first words of licences.
WORD = r"(?<![a-z0-9_])"
OPENINGS = rf"({SIGN}{GAP}*(?:copyright)?|{WORD}(?:copyright[,:]?{GAP}*(?:{SIGN}|by{GAP})?|all{GAP}+rights{GAP}+reserved|permission{GAP}+(?:is|to){GAP}|redistribution{GAP}+and{GAP}+use|licen[sc]ed{GAP}+under|released{GAP}+under|everyone{GAP}+is{GAP}+permitted|this{GAP}+(?:software|program|library|file|work|is{GAP}+free)|the{GAP}+above{GAP}+copyright|(?:the{GAP}+)?(?:mit|isc|bsd|zlib|apache){GAP}+licen[sc]e))"
STATEMENT = rf"^(?:copyright[,:]?{GAP}*(?:{SIGN}|{YEAR}|by{GAP})|{SIGN}{GAP}*(?:copyright{GAP}*)?{YEAR}|©{GAP}*copyright)"
BARE = rf"^(?:copyright|©){GAP}+([^ \t\r\n.,;:]+)"
#: Words after "copyright" in licences' own prose.
PROSE = ("notice notices holder holders owner owners license licenses licence licences law laws statement statements act acts and or in is to of on disclaimer disclaimers permission permissions interest interests treaty protection for with claim claims infringement the this that as may").split()
SHORT = r"(inc|ltd|corp|co|jr|sr|dr|st|al|[a-z])\."
RESERVED = rf"all{GAP}+rights{GAP}+reserved"
MOST_WORDS = 100
NO_WORD = r"[^\p{L}\p{N}]+"
#: Separators of paragraphs, of pieces, and after sentences: no letters, so they are of no account afterwards.
PARAGRAPH, PIECE, SENTENCE = "\x1d", "\x1e", "\x1f"
#: Cuts in order: a pattern and what takes its place (groups as in Java).
CUTS = (
    (r"\n(?:[ \t\r]*\n)+", PARAGRAPH),
    (rf"(licen[sc]e\)?{GAP}+)(copyright|©)", f"$1{PARAGRAPH}$2"),
    (OPENINGS, f"{PIECE}$1"),
    (rf"{WORD}{SHORT}", "$1 "),
    (rf"([.;:!?]){GAP}", f"$1{SENTENCE}"),
)


def unstated(text: Column) -> Column:
    """Lower-case text without its copyright statements."""
    out = text
    for pattern, by in CUTS:
        out = F.regexp_replace(out, pattern, by)
    begins = lambda p: F.regexp_replace(p, rf"^{GAP}+", "")

    def kept(paragraph: Column) -> Column:
        pieces = F.transform(F.split(paragraph, f"[{PIECE}{SENTENCE}]"), begins)
        bare = lambda p: ~F.regexp_extract(p, BARE, 1).isin("", *PROSE)
        first = F.coalesce(F.get(pieces, F.lit(1)), F.lit(""))
        opens = (F.get(pieces, F.lit(0)) == "") & (first.rlike(STATEMENT) | bare(first))
        few = lambda p: F.size(F.split(p, rf"{GAP}+")) <= MOST_WORDS
        return F.array_join(F.filter(pieces, lambda p: ~((p.rlike(STATEMENT) | (opens & bare(p))) & few(p))), " ")

    return F.array_join(F.transform(F.split(out, PARAGRAPH), kept), " ")


def canonical(low: Column, whole: bool) -> Column:
    """The form that digests are taken of, from text in lower case; of a whole text without its copyright statements, wherever its lines break."""
    out = low
    if whole:
        out = F.when(out.contains("copyright") | out.contains("(c)") | out.contains("©"), unstated(out)).otherwise(out)
        out = F.when(out.contains("reserved"), F.regexp_replace(out, RESERVED, " ")).otherwise(out)
    out = F.concat(F.lit(" "), F.regexp_replace(F.replace(out, F.lit("&"), F.lit(" and ")), NO_WORD, " "), F.lit(" "))
    other = F.lit(" (?:" + "|".join(SPELLINGS) + ") ")
    doubled = F.replace(out, F.lit(" "), F.lit("  "))
    for old, new in SPELLINGS.items():
        doubled = F.replace(doubled, F.lit(f" {old} "), F.lit(f" {new} "))
    out = F.when(F.regexp_like(out, other), F.replace(doubled, F.lit("  "), F.lit(" "))).otherwise(out)
    return F.trim(out)


def canonical_text(text: str, whole: bool) -> str:
    """The same for the known texts, on the driver."""
    low = text.lower()
    if whole and re.search(r"copyright|\(c\)|©", low):
        for pattern, by in CUTS:
            low = re.sub(pattern, by.replace("$", "\\"), low)
        kept = []
        for paragraph in low.split(PARAGRAPH):
            pieces = [p.lstrip(" \t\r\n") for p in re.split(f"[{PIECE}{SENTENCE}]", paragraph)]
            bare = lambda p: (m := re.search(BARE, p)) is not None and m[1] not in PROSE
            first = pieces[1] if len(pieces) > 1 else ""
            opens = pieces[0] == "" and bool(re.search(STATEMENT, first) or bare(first))
            kept += [p for p in pieces if not ((re.search(STATEMENT, p) or opens and bare(p)) and len(re.split(f"{GAP}+", p)) <= MOST_WORDS)]
        low = " ".join(kept)
    return words_of(re.sub(RESERVED, " ", low) if whole else low)


def words_of(out: str) -> str:
    words = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in out.replace("&", " and ")).split()
    return " ".join(SPELLINGS.get(w, w) for w in words)


def known_digests(known: dict[str, str] | None = None, titles: dict[str, tuple[str, ...]] | None = None) -> dict[str, str]:
    """Digest to licence: each text with any of its titles and without one; with the default texts, the long licences too."""
    out = {} if known else dict(DIGESTS)
    for name, text in (known or LICENCES).items():
        for title in ("", *(TITLES if titles is None else titles).get(name, ())):
            out[digest(canonical_text(f"{title}\n\n{text}", True))] = name
    return out


def key_words(lines: list[str]) -> list[str]:
    """For each canonical line a word that a line must hold, as it is, to have that form; none at all if some line has no such word."""
    made = {*SPELLINGS.values(), "and"}
    words = [max((w for w in x.split() if w not in made), key=len, default="") for x in lines]
    return sorted(set(words)) if all(words) else []


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def licences(docs: DataFrame, known: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """doc_id, digest, license_id, notice_ids for every row of docs (doc_id, text).

    digest: SHA-256 of the canonical text. license_id: of the known licence with
    that digest, null if there is none. notice_ids: of the lines that are known notices, each once,
    in order, with a comma between; empty if there is none. Null text counts as empty, and no licence is. Very long texts are read whole. Null
    ids and repeated rows stay, one row out for each row in; other columns are not
    read; an empty table gives an empty one. No text is shuffled; the known digests are
    a table whose size does not depend on the input.
    """
    spark = docs.sparkSession
    lines = {canonical_text(t, False): name for t, name in (notices or NOTICES).items()}
    listed = spark.createDataFrame(sorted(known_digests(known).items()), "known_digest string, license_id string")
    low = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    of_line = F.create_map(*[F.lit(x) for pair in sorted(lines.items()) for x in pair])
    looked_at = F.split("low", "\n")
    if keys := key_words(list(lines)):
        holds = lambda x: reduce(Column.__or__, [x.contains(k) for k in keys])
        looked_at = F.filter(looked_at, holds)
    found = F.array_compact(F.transform(looked_at, lambda x: F.element_at(of_line, canonical(x, False))))
    rows = docs.select("doc_id", low.alias("low"))
    rows = rows.select("doc_id", F.sha2(canonical(F.col("low"), True), 256).alias("digest"), F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("notice_ids"))
    return rows.join(F.broadcast(listed), rows["digest"] == listed["known_digest"], "left").select("doc_id", "digest", "license_id", "notice_ids")


def oracle() -> str:
    """licences() over documents as DuckDB SQL: texts as rows of paragraphs and pieces, words as rows for their spelling."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    cut = "lower(t)"
    for pattern, by in CUTS:
        pattern = pattern.replace(WORD, r"\b")
        cut = f"regexp_replace({cut}, {quote(pattern)}, {quote(by.replace('$', chr(92)))}, 'g')"
    table = ", ".join(f"('{d}', '{n}')" for d, n in sorted(known_digests().items()))
    lines = ", ".join(f"('{canonical_text(t, False)}', '{n}')" for t, n in NOTICES.items())
    spelt = ", ".join(f"('{old}', '{new}')" for old, new in SPELLINGS.items())
    prose = ", ".join(quote(w) for w in PROSE)
    words = lambda x: f"list_filter(string_split(regexp_replace(replace({x}, '&', ' and '), '{NO_WORD}', ' ', 'g'), ' '), lambda w: w <> '')"
    states, bare = f"regexp_matches(p, {quote(STATEMENT)})", f"(regexp_matches(p, {quote(BARE)}) and regexp_extract(p, {quote(BARE)}, 1) not in ({prose}))"
    return f"""
with known(d, license_id) as (values {table}), notices(d, n) as (values {lines}), spelt(old, new) as (values {spelt}),
docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
paragraphs as (select r, i, string_split(cut, chr(29))[i] as p from (select r, {cut} as cut from docs where lower(t) like '%copyright%' or lower(t) like '%(c)%' or lower(t) like '%©%') x, unnest(generate_series(1, len(string_split(cut, chr(29))))) u(i)),
pieces as (select r, i, j, regexp_replace(list[j], '^{GAP}+', '') as p from (select r, i, string_split_regex(p, '[\x1e\x1f]') as list from paragraphs) x, unnest(generate_series(1, len(list))) u(j)),
judged as (select r, i, j, p, {states} as states, {bare} as bare, len(string_split_regex(p, '{GAP}+')) as n from pieces),
opening as (select r, i, bool_and(case j when 1 then p = '' else states or bare end) and count(*) = 2 as opens from judged where j <= 2 group by r, i),
unstated as (select r, string_agg(p, ' ' order by i, j) as t from judged join opening using (r, i) where not ((states or opens and bare) and n <= {MOST_WORDS}) group by r),
whole as (select docs.r, {words(f"regexp_replace(case when p.r is null then lower(docs.t) else coalesce(unstated.t, '') end, '{RESERVED}', ' ', 'g')")} as w from docs left join (select distinct r from paragraphs) p on p.r = docs.r left join unstated on unstated.r = docs.r),
one as (select r, i, w[i] as word from whole, unnest(generate_series(1, len(w))) u(i)),
digests as (select r, sha256(string_agg(coalesce(new, word), ' ' order by i)) as digest from one left join spelt on old = word group by r),
lines as (select row_number() over () as l, r, {words('line')} as w from (select r, unnest(string_split(lower(t), chr(10))) as line from docs)),
shown as (select l, any_value(r) as r, string_agg(coalesce(new, w[i]), ' ' order by i) as d from lines, unnest(generate_series(1, len(w))) u(i) left join spelt on old = w[i] where len(w) <= 24 group by l),
found as (select r, string_agg(distinct n, ',' order by n) as ids from shown join notices on notices.d = shown.d group by r)
select doc_id, coalesce(x.digest, sha256('')) as digest, license_id, coalesce(ids, '') as notice_ids
from docs left join digests x on x.r = docs.r left join known on known.d = coalesce(x.digest, sha256('')) left join found on found.r = docs.r
"""

"""The line protocol: commands parsed as columns, answered in batches from a store, and a session for one client.

Answers are rows (seq, row, line): seq is the command's, and row puts the lines of one answer in order (gaps are allowed, so
no answer has to be gathered in one place).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.scalars import digest, has_digest_length, same_digest
from cairn.operators import catalog
from cairn.operators.chunking import new_chunks
from cairn.operators.lifecycle import Store, missing_of
from cairn.operators.retrieve import chunks_of
from cairn.operators.sync import has_chunk
from cairn.schema import CHUNK_SIZE, CHUNKS, DEFAULT_PORT, MANIFESTS, MOST_CHUNKS, PRODUCT, VERSION, WIRE_LIST_CAP

# The verbs of the protocol, and what HELP lists.
VERBS = ("PING", "INFO", "HELP", "LIST", "HISTORY", "HAS_CHUNK", "STORE_CHUNK", "GET_CHUNK", "GET_META", "UPLOAD_META", "QUIT", "EXIT")
HELP = "OK Supported commands: PING, LIST, INFO, HISTORY <file>, HAS_CHUNK <hash>, STORE_CHUNK <hash> <len>, GET_CHUNK <hash>, GET_META <file> [ver], UPLOAD_META <file> <size> <count>, HELP, QUIT"
INFO = f"OK {PRODUCT} {VERSION} (chunk_size={CHUNK_SIZE}, default_port={DEFAULT_PORT})"
REPLIES = "seq bigint, row bigint, line string"
NUMBER = r"[+-]?[0-9]+"


def parsed(commands: DataFrame) -> DataFrame:
    """seq, verb (upper case), argument, known of command lines (seq, line); blank lines are left out.

    The first space parts verb and argument; white space around either is dropped.
    """
    return _parsed(commands).select("seq", "verb", "argument", "known")


def _parsed(commands: DataFrame) -> DataFrame:
    line = F.regexp_replace("line", r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    others = [c for c in commands.columns if c not in ("seq", "line")]
    parts = commands.select("seq", line.alias("line"), *others).filter(F.col("line") != "")
    verb = F.upper(F.regexp_extract("line", r"^([^ ]*)", 1))
    argument = F.regexp_extract("line", r"^[^ ]* *(.*)$", 1)
    return parts.withColumns({"verb": verb, "argument": argument, "known": verb.isin(*VERBS)})


def _answer(rows: DataFrame, line: Column, row: Column | int = 0) -> DataFrame:
    at = F.lit(row) if isinstance(row, int) else row
    return rows.select("seq", at.cast("bigint").alias("row"), line.alias("line"))


def _word(i: int) -> Column:
    """The i-th word of the argument, null where there is none."""
    return F.get(F.filter(F.split("argument", r"\s+"), lambda w: w != ""), F.lit(i))


def _plain(asked: DataFrame) -> DataFrame:
    verb, argument = F.col("verb"), F.col("argument")
    line = F.when(verb == "PING", F.when(argument == "", "PONG").otherwise(F.concat(F.lit("PONG "), argument)))
    line = line.when(verb == "INFO", F.lit(INFO)).when(verb == "HELP", F.lit(HELP)).when(verb.isin("QUIT", "EXIT"), F.lit("BYE"))
    line = line.when(~F.col("known"), F.concat(F.lit("ERR Unknown command: "), "line"))
    return _answer(asked, line).filter(F.col("line").isNotNull())


def _list(asked: DataFrame, store: Store, cap: int) -> DataFrame:
    """The catalog is cut to `cap` names by name, so what each LIST is joined with is bounded."""
    rows = catalog.capped(catalog.listing(store.manifests), cap)
    turn = F.row_number().over(Window.partitionBy("verb").orderBy("name"))
    rows = rows.select(F.lit("LIST").alias("verb"), "name", F.concat_ws(" ", "name", F.col("versions").cast("string"), F.col("latest_size").cast("string")).alias("shown")).withColumn("turn", turn)
    asked = asked.filter(F.col("verb") == "LIST").select("seq", "verb")
    counts = rows.groupBy("verb").agg(F.count("*").alias("n"))
    counted = asked.join(F.broadcast(counts), "verb", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    head = _answer(counted, F.format_string("OK %d files", "n"))
    return head.unionByName(_answer(asked.join(F.broadcast(rows), "verb"), F.col("shown"), F.col("turn"))).unionByName(_answer(counted, F.lit("END"), F.col("n") + 1))


def _history(asked: DataFrame, store: Store) -> DataFrame:
    asked = asked.filter(F.col("verb") == "HISTORY").select("seq", F.col("argument").alias("name"))
    named = asked.filter(F.col("name") != "")
    top = store.manifests.groupBy("name").agg(F.max("version").alias("top"))
    known = named.join(top, "name", "left")
    total = F.format_string("OK %d versions", "top")
    head = _answer(known, F.when(F.col("top").isNull(), "ERR No versions found for file").otherwise(total))
    shown = F.format_string("v%d %d %d %d", "version", "file_size", "num_chunks", "timestamp")
    rows = _answer(named.join(store.manifests.drop("chunk_hashes"), "name"), shown, F.col("version"))
    out = head.unionByName(rows).unionByName(_answer(known.filter(F.col("top").isNotNull()), F.lit("END"), F.col("top") + 1))
    return out.unionByName(_answer(asked.filter(F.col("name") == ""), F.lit("ERR Missing filename for HISTORY")))


def _chunk(asked: DataFrame, store: Store) -> DataFrame:
    """HAS_CHUNK and GET_CHUNK; the body of a chunk is a line of hex digits. Digests count whatever their case."""
    asked = asked.filter(F.col("verb").isin("HAS_CHUNK", "GET_CHUNK")).select("seq", "verb", F.lower("argument").alias("hash"), has_digest_length(F.col("argument")).alias("valid"))
    bad = _answer(asked.filter(~F.col("valid")), F.lit("ERR Invalid hash"))
    has = asked.filter(F.col("valid") & (F.col("verb") == "HAS_CHUNK"))
    found = has.join(has_chunk(has, store.chunks), "hash")
    got = asked.filter(F.col("valid") & (F.col("verb") == "GET_CHUNK"))
    held = chunks_of(store, got)
    sizes = got.join(held.select("hash", "size"), "hash", "left")
    head = F.when(F.col("size").isNull(), "ERR Chunk not found").otherwise(F.format_string("OK %d", "size"))
    body = _answer(got.join(held.select("hash", "data"), "hash"), F.lower(F.hex("data")), 1)
    return bad.unionByName(_answer(found, F.format_string("OK %d", F.col("present").cast("int")))).unionByName(_answer(sizes, head)).unionByName(body)


def _meta(asked: DataFrame, store: Store) -> DataFrame:
    asked = asked.filter(F.col("verb") == "GET_META").select("seq", _word(0).alias("name"), _word(1).alias("number"))
    valid = F.col("number").isNull() | F.col("number").rlike(f"^{NUMBER}$")
    version = F.coalesce(F.when(F.col("number").isNull(), F.lit(-1)).otherwise(F.expr("try_cast(number as bigint)")), F.lit(0)).cast("bigint")
    named = asked.filter(F.col("name").isNotNull() & valid).select("seq", "name", version.alias("version"))
    found = catalog.resolved(store.manifests, named.select("name", "version").distinct())
    rows = named.withColumnRenamed("version", "asked").join(found, ["name", "asked"], "left")
    head = F.when(F.col("version").isNull(), "ERR File or version not found").otherwise(F.format_string("OK %d %d %d %d", "version", "file_size", "num_chunks", "timestamp"))
    there = rows.filter(F.col("version").isNotNull())
    hashes = there.select("seq", F.posexplode("chunk_hashes").alias("i", "hash"))
    out = _answer(rows, head).unionByName(_answer(hashes, F.col("hash"), F.col("i") + 1)).unionByName(_answer(there, F.lit("END"), F.size("chunk_hashes") + 1))
    wrong = F.when(F.col("name").isNull(), "ERR Missing filename for GET_META").when(~valid, "ERR Invalid GET_META arguments")
    return out.unionByName(_answer(asked, wrong).filter(F.col("line").isNotNull()))


def replies(commands: DataFrame, store: Store, list_cap: int = WIRE_LIST_CAP, verbs: tuple[str, ...] = VERBS) -> DataFrame:
    """seq, row, line: the answers to command lines (seq, line) that change nothing. verbs: those that may occur, so that others cost nothing."""
    asked = _parsed(commands)
    out = [_plain(asked)]
    for names, answer in ((("LIST",), lambda: _list(asked, store, list_cap)), (("HISTORY",), lambda: _history(asked, store)), (("HAS_CHUNK", "GET_CHUNK"), lambda: _chunk(asked, store)), (("GET_META",), lambda: _meta(asked, store))):
        if set(names) & set(verbs):
            out.append(answer())
    made = out[0]
    for x in out[1:]:
        made = made.unionByName(x)
    return made


def stored(commands: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """The answers to STORE_CHUNK lines (seq, line, body: binary), and the chunks that the store gets."""
    asked = _parsed(commands).filter(F.col("verb") == "STORE_CHUNK").select("seq", _word(0).alias("hash"), _word(1).alias("length"), F.coalesce("body", F.lit(b"")).alias("body"))
    asked = asked.withColumn("size", F.when(F.col("length").rlike("^[0-9]+$"), F.expr("try_cast(length as bigint)")))
    data = F.col("body").substr(F.lit(1), F.least(F.col("size"), F.lit(CHUNK_SIZE)).cast("int"))
    asked = asked.withColumn("data", data).withColumn("own", digest(F.col("data")))
    wrong = F.when(F.col("hash").isNull(), "ERR Missing arguments for STORE_CHUNK").when(F.col("size").isNull() | ~has_digest_length(F.col("hash")), "ERR Invalid STORE_CHUNK format")
    wrong = wrong.when(F.col("size") > CHUNK_SIZE, "ERR Chunk exceeds maximum size").when(~same_digest(F.col("own"), F.col("hash")) | (F.octet_length("data") != F.col("size")), "ERR Hash mismatch")
    fine = asked.filter(wrong.isNull()).select(F.col("own").alias("hash"), F.col("size").alias("n"), "data")
    return _answer(asked, F.coalesce(wrong, F.lit("OK"))), new_chunks(fine, store.chunks)


def uploaded(commands: DataFrame, store: Store, most_chunks: int = MOST_CHUNKS) -> tuple[DataFrame, DataFrame]:
    """The answers to UPLOAD_META lines (seq, line, timestamp, lines: the chunk list and its END), and the manifests that the store gets.

    The receiver numbers versions, those of one name in the order of seq.
    """
    asked = _parsed(commands).filter(F.col("verb") == "UPLOAD_META").select("seq", "timestamp", _word(0).alias("name"), _word(1).alias("bytes"), _word(2).alias("many"), F.transform(F.coalesce("lines", F.array().cast("array<string>")), lambda x: F.trim(x)).alias("lines"))
    number = lambda c: F.when(F.col(c).rlike(f"^{NUMBER}$"), F.expr(f"try_cast({c} as bigint)"))
    asked = asked.withColumn("file_size", number("bytes")).withColumn("num_chunks", number("many"))
    within = F.greatest(F.least(F.col("num_chunks"), F.lit(most_chunks)), F.lit(0)).cast("int")
    asked = asked.withColumn("chunk_hashes", F.transform(F.slice("lines", F.lit(1), within), lambda h: F.lower(h)))
    listed = (F.size("chunk_hashes") == F.col("num_chunks")) & F.forall("chunk_hashes", has_digest_length) & F.coalesce(F.upper(F.get("lines", within)) == "END", F.lit(False))
    wrong = F.when(F.col("name").isNull(), "ERR Missing arguments for UPLOAD_META").when(F.col("file_size").isNull() | F.col("num_chunks").isNull(), "ERR Invalid UPLOAD_META format")
    wrong = wrong.when(~F.col("num_chunks").between(0, most_chunks), "ERR Invalid chunk count").when(~listed, "ERR Failed reading chunk list")
    asked = asked.withColumn("wrong", wrong)
    lists = asked.filter(F.col("wrong").isNull()).select(F.col("name"), F.col("seq").alias("version"), "chunk_hashes")
    lacking = missing_of(lists, store.chunks).select(F.col("version").alias("seq")).distinct().withColumn("lacks", F.lit("ERR Incomplete upload: missing chunks"))
    asked = asked.join(lacking, "seq", "left").withColumn("wrong", F.coalesce("wrong", "lacks"))
    ok = asked.filter(F.col("wrong").isNull())
    turn = F.row_number().over(Window.partitionBy("name").orderBy("seq")) - 1
    turns = ok.select("seq", "name", turn.alias("turn")).join(catalog.next_versions(store.manifests, ok), "name").select("seq", (F.col("next_version") + F.col("turn")).alias("version"))
    told = asked.select("seq", "wrong").join(turns, "seq", "left")
    taken = ok.join(turns, "seq").select("name", "version", "num_chunks", "file_size", "timestamp", "chunk_hashes")
    return _answer(told, F.coalesce("wrong", F.format_string("OK %d", "version"))), taken


class Session:
    """Answers command lines from a store one by one, and keeps what they change. One writer; each answer is a list of lines.

    An interactive façade: an answer is collected by the driver, as one client
    asks for one answer. Whole catalogs and stores are handled by the operators instead.
    What it was sent is held by the driver until the session ends, in one table of either kind.
    """

    def __init__(self, spark: SparkSession, store: Store, clock=lambda: 0, list_cap: int = WIRE_LIST_CAP):
        self.spark, self.base, self.clock, self.list_cap = spark, store, clock, list_cap
        self.chunks, self.manifests, self.open = [], [], True

    @property
    def store(self) -> Store:
        manifests, chunks = self.base.manifests, self.base.chunks
        if self.manifests:
            manifests = manifests.unionByName(self.spark.createDataFrame(self.manifests, MANIFESTS))
        if self.chunks:
            chunks = chunks.unionByName(self.spark.createDataFrame(self.chunks, CHUNKS).select(*chunks.columns))
        return Store(manifests, chunks)

    def execute(self, line: str, body: bytes | list[str] | None = None) -> list[str]:
        verb = line.strip().partition(" ")[0].upper()
        if verb == "STORE_CHUNK":
            asked = self.spark.createDataFrame([(0, line, bytearray(body or b""))], "seq bigint, line string, body binary")
            told, new = stored(asked, self.store)
            self.chunks += new.select("hash", "size", "data", "prefix").collect()
        elif verb == "UPLOAD_META":
            asked = self.spark.createDataFrame([(0, line, int(self.clock()), list(body or []))], "seq bigint, line string, timestamp bigint, lines array<string>")
            told, new = uploaded(asked, self.store)
            told = self.spark.createDataFrame(told.collect(), REPLIES)  # before the store changes
            self.manifests += new.collect()
        else:
            told = replies(self.spark.createDataFrame([(0, line)], "seq bigint, line string"), self.store, self.list_cap, (verb,))
        self.open = self.open and verb not in ("QUIT", "EXIT")
        return [r["line"] for r in told.orderBy("row").collect()]


def run_script(session: Session, commands: list[str]) -> list[list[str]]:
    """The answers to commands without bodies, up to the one that closes the session."""
    out = []
    for line in commands:
        if not session.open:
            break
        out.append(session.execute(line))
    return out

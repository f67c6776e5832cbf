"""The registered queries of the store's operators, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import scalars
from cairn.operators import catalog, chunking, lifecycle, retrieve, sync
from cairn.operators.lifecycle import Store
from cairn.plans import datasets, protocol
from cairn.schema import CHUNKS, MANIFESTS
from cairn.session import shared_folder
from cairn.sources import files, metatext
from cairn.sources.store import ParquetStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

STAMP = datasets.STAMP
DOCUMENTS = f"select cast(doc_id as varchar) as name, 1::bigint as version, {STAMP} + doc_id as ts, encode(text) as bb from documents"
CONVERSATIONS = f"select cast(conv_id as varchar) as name, (turn + 1)::bigint as version, {STAMP} + conv_id * 1000 + turn as ts, encode(text) as bb from conversations"
SOURCES = f"select source as name, row_number() over (partition by source order by doc_id) as version, {STAMP} + doc_id as ts, encode(text) as bb from documents"
PAGES = f"select url as name, 1::bigint as version, {STAMP} + page_id as ts, encode(html) as bb from pages"
EVENTS = "select cast(user_id as varchar) as name, row_number() over (partition by user_id order by event_id) as version, octet_length(encode(props))::bigint as file_size, floor(epoch(ts))::bigint as ts from events"
NODES = "a as (select distinct hash from ch where name::bigint % 2 = 0), "


def cut_sql(src: str, size: int = datasets.CHUNK) -> str:
    """Common table expressions: ch has name, version, ts, idx, hash, n, d of each slice of src."""
    return f"""with b as ({src}),
c as (select name, version, ts, i::bigint as idx, array_slice(bb, (i * {size} + 1)::bigint, ((i + 1) * {size})::bigint) as d
      from (select name, version, ts, bb, unnest(range(0, greatest((octet_length(bb) + {size - 1}) // {size}, 1))) as i from b)),
ch as (select name, version, ts, idx, sha256(d) as hash, octet_length(d)::bigint as n, d from c),
m as (select name, version, ts, count(*)::bigint as num_chunks, sum(n)::bigint as file_size, string_agg(hash, ',' order by idx) as list from ch group by name, version, ts),
{NODES}z as (select 1)
"""


def sized_sql(src: str) -> str:
    return f"with m as (select name, version, ts, octet_length(bb)::bigint as file_size, greatest((octet_length(bb) + 1023) // 1024, 1)::bigint as num_chunks from ({src}))"


def label_sql(size: str, gigabytes: bool = False) -> str:
    top = f"when {size} < 1073741824 then printf('%.1f MB', {size}::double / 1048576) else printf('%.1f GB', {size}::double / 1073741824)" if gigabytes else f"else printf('%.1f MB', {size}::double / 1048576)"
    return f"case when {size} < 1024 then {size} || ' B' when {size} < 1048576 then printf('%.1f KB', {size}::double / 1024) {top} end"


def time_sql(seconds: str) -> str:
    return f"strftime(make_timestamp({seconds} * 1000000), '%Y-%m-%d %H:%M:%S')"


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def listed(manifests: DataFrame) -> DataFrame:
    """manifests with the digest of their list in place of the list."""
    return manifests.select("name", "version", "num_chunks", "file_size", "timestamp", F.sha2(F.array_join("chunk_hashes", ","), 256).alias("list_digest"))


def empty_store(spark: SparkSession) -> Store:
    return Store(spark.createDataFrame([], MANIFESTS), spark.createDataFrame([], CHUNKS))


def names_of(spark: SparkSession, *rows: tuple, schema: str = "name string") -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


@query(f"select name, sha256(bb) as hash from ({DOCUMENTS})")
def sha256_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.documents(spark, sf_dir).select("name", scalars.digest(F.col("data")).alias("hash"))


@query(cut_sql(DOCUMENTS, 4194304) + "select name, idx, n, hash from ch")
def chunk_default_4m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.slices(datasets.documents(spark, sf_dir)).select("name", "idx", "n", "hash")


@query(cut_sql(PAGES) + "select name, idx, n, hash from ch")
def chunk_1k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.slices(datasets.pages(spark, sf_dir), datasets.CHUNK).select("name", "idx", "n", "hash")


@query(f"select name, 'data/chunks/' || substr(h, 1, 2) as dir, 'data/chunks/' || substr(h, 1, 2) || '/' || h as path, 'data/meta/' || name || '/v' || version || '.meta' as meta from (select name, version, sha256(bb) as h from ({DOCUMENTS}))")
def chunk_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = scalars.digest(F.col("data"))
    return datasets.documents(spark, sf_dir).select("name", scalars.chunk_dir(h).alias("dir"), scalars.chunk_path(h).alias("path"), scalars.meta_path(F.col("name"), F.col("version")).alias("meta"))


@query("select url, regexp_extract(url, '([^/]+)/*$', 1) as base, lower(hex(encode(regexp_extract(url, '([^/]+)/*$', 1)))) as base_hex, coalesce(try_cast(regexp_extract(regexp_extract(url, '([^/]+)/*$', 1), '^\\s*([+-]?\\d+)', 1) as bigint), 0) as leading, page_id as version from pages")
def name_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scalars.base_name(F.col("url"))
    file = F.concat(F.lit("v"), F.col("page_id").cast("string"), F.lit(".meta"))
    rows = datasets.table(spark, sf_dir, "pages").select("url", "page_id", base.alias("base"), file.alias("file"))
    return rows.select("url", "base", scalars.hex_of(F.encode("base", "UTF-8")).alias("base_hex"), scalars.leading_integer(F.col("base")).alias("leading"), scalars.version_of_file(F.col("file")).alias("version"))


@query(cut_sql(DOCUMENTS) + "select name, idx, hash, row_number() over (partition by hash order by name::bigint, idx) = 1 as is_new from ch")
def ingest_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = chunking.slices(datasets.documents(spark, sf_dir), datasets.CHUNK).withColumn("doc", F.col("name").cast("bigint"))
    return chunking.ingest_flags(cut, ["doc", "idx"]).select("name", "idx", "hash", "is_new")


@query(cut_sql(DOCUMENTS) + "select distinct hash, n as size, substr(hash, 1, 2) as prefix from ch")
def cas_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.distinct_chunks(chunking.slices(datasets.documents(spark, sf_dir), datasets.CHUNK)).select("hash", "size", "prefix")


@query(cut_sql(DOCUMENTS) + "select distinct ch.hash, ch.n as size from ch where ch.hash not in (select hash from a)")
def store_new_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    node, _ = datasets.two_nodes(spark, sf_dir)
    return chunking.new_chunks(chunking.slices(datasets.documents(spark, sf_dir), datasets.CHUNK), node.chunks).select("hash", "size")


@query(cut_sql(DOCUMENTS) + "select name, version, count(*)::bigint as n_chunks, sum(case when a.hash is not null then 1 else 0 end)::bigint as n_present, sum(case when a.hash is null then 1 else 0 end)::bigint as n_sent from ch left join a on a.hash = ch.hash group by name, version")
def dedup_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    node, _ = datasets.two_nodes(spark, sf_dir)
    return sync.dedup_counts(chunking.slices(datasets.documents(spark, sf_dir), datasets.CHUNK), node.chunks)


@query(cut_sql(PAGES) + "select name, version, num_chunks, file_size, ts as timestamp, sha256(list) as list_digest from m")
def manifest_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(chunking.manifests_of(chunking.slices(datasets.pages(spark, sf_dir), datasets.CHUNK)))


@query(sized_sql(CONVERSATIONS) + " select n.name, coalesce(max(m.version), 0) + 1 as next_version from (select distinct name from m union all select 'unknown') n left join m on m.name = n.name group by n.name")
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifests = datasets.sized(datasets.conversations(spark, sf_dir))
    return catalog.next_versions(manifests, catalog.names(manifests).unionByName(names_of(spark, ("unknown",))))


@query(sized_sql(CONVERSATIONS) + " select name, max(version) as versions, count(*)::bigint as n_readable from m group by name")
def version_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.version_counts(datasets.sized(datasets.conversations(spark, sf_dir)))


@query(sized_sql(CONVERSATIONS) + " select distinct name from m")
def catalog_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.names(datasets.sized(datasets.conversations(spark, sf_dir)))


@query(sized_sql(CONVERSATIONS) + " select count(distinct name)::bigint as files from m")
def file_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.file_count(datasets.sized(datasets.conversations(spark, sf_dir)))


@query(sized_sql(CONVERSATIONS) + " select name, max(version) as version, arg_max(num_chunks, version) as num_chunks, arg_max(file_size, version) as file_size, arg_max(ts, version) as timestamp from m group by name")
def resolve_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest(datasets.sized(datasets.conversations(spark, sf_dir)))


@query(sized_sql(SOURCES) + ", t as (select name, max(version) as top from m group by name), q as (select name, 3 as asked from t union all select name, -1 from t union all select name, 1000000000 from t) select q.name, asked::bigint as asked, m.version, num_chunks, file_size, ts as timestamp from q join t on t.name = q.name join m on m.name = q.name and m.version = case when asked = -1 then top else asked end")
def resolve_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifests = datasets.sources(spark, sf_dir)
    asked = catalog.names(manifests).withColumn("version", F.explode(F.array(*[F.lit(v).cast("bigint") for v in (3, -1, 1_000_000_000)])))
    return catalog.resolved(manifests, asked)


@query(f"with m as (select name, version, file_size, greatest((file_size + 1023) // 1024, 1)::bigint as num_chunks, ts from ({EVENTS})) select name, version, file_size, num_chunks, ts as timestamp, {label_sql('file_size')} as size_label, num_chunks || case when num_chunks = 1 then ' chunk' else ' chunks' end as chunk_label, {time_sql('ts')} as time_label, version = max(version) over (partition by name) as is_latest from m")
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.history(datasets.events(spark, sf_dir))


@query(sized_sql(CONVERSATIONS) + f" select name, version, file_size, num_chunks, ts as timestamp, {label_sql('file_size')} as size_label, num_chunks || case when num_chunks = 1 then ' chunk' else ' chunks' end as chunk_label, {time_sql('ts')} as time_label, version = max(version) over () as is_latest from m where name = '3'")
def history_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.history(datasets.sized(datasets.conversations(spark, sf_dir)), "3")


@query(sized_sql(SOURCES) + " select name, version, file_size from (select *, row_number() over (partition by name order by version) as r from m) where r <= 2")
def version_list_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.version_list(datasets.sources(spark, sf_dir), 2).select("name", "version", "file_size")


LISTING = " select name, max(version) as versions, max(version) || case when max(version) = 1 then ' version' else ' versions' end as version_label, arg_max(file_size, version) as latest_size, {label} as size_label from m group by name"


@query(sized_sql(CONVERSATIONS) + LISTING.format(label=label_sql("arg_max(file_size, version)")))
def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.listing(datasets.sized(datasets.conversations(spark, sf_dir)))


@query(sized_sql(SOURCES) + LISTING.format(label=label_sql("arg_max(file_size, version)", True)))
def remote_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.listing(datasets.sources(spark, sf_dir), gigabytes=True)


@query(sized_sql(CONVERSATIONS) + LISTING.format(label=label_sql("arg_max(file_size, version)")) + " order by name limit 10")
def list_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.capped(catalog.listing(datasets.sized(datasets.conversations(spark, sf_dir))), 10)


@query(cut_sql(CONVERSATIONS) + f", t as (select name, max(version) as top from m group by name) select m.name, top + 1 as version, num_chunks, file_size, {STAMP}::bigint as timestamp, sha256(list) as list_digest from m join t on t.name = m.name where m.version = 1 and top > 1")
def restore_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = datasets.store(datasets.conversations(spark, sf_dir))
    wanted = catalog.names(store.manifests).withColumn("version", F.lit(1).cast("bigint"))
    return listed(lifecycle.restore(store, wanted, STAMP))


@query(
    sized_sql(CONVERSATIONS)
    + """, t as (select name, max(version) as top from m group by name),
q as (select name, v::bigint as version from t, (values (0), (1), (2)) x(v) union select name, top from t union select 'unknown', 1)
select q.name, q.version, case when q.version < 1 then 'invalid' when m.name is null then 'not found' when q.version = top then 'already latest' else 'ok' end as status,
case when q.version >= 1 and m.name is not null and q.version <> top then top + 1 end as new_version
from q left join t on t.name = q.name left join m on m.name = q.name and m.version = q.version"""
)
def restore_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = datasets.store(datasets.conversations(spark, sf_dir))
    names = catalog.names(store.manifests)
    asked = names.withColumn("version", F.explode(F.array(*[F.lit(v).cast("bigint") for v in (0, 1, 2)])))
    asked = asked.unionByName(store.manifests.groupBy("name").agg(F.max("version").alias("version")))
    return lifecycle.restore_status(store, asked.unionByName(names_of(spark, ("unknown", 1), schema="name string, version bigint")))


@query(cut_sql(DOCUMENTS) + "select distinct ch.hash, ch.hash in (select hash from a) as present from ch")
def has_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    node, other = datasets.two_nodes(spark, sf_dir)
    return sync.has_chunk(other.chunks, node.chunks)


@query(cut_sql(DOCUMENTS) + "select name, version, idx, hash from ch where hash not in (select hash from a)")
def missing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    node, _ = datasets.two_nodes(spark, sf_dir)
    return lifecycle.missing_of(node.manifests, node.chunks)


@query(cut_sql(DOCUMENTS) + "select name, version, min(idx) as first_missing from ch where hash not in (select hash from a) group by name, version")
def first_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    node, _ = datasets.two_nodes(spark, sf_dir)
    return retrieve.first_missing(node)


@query(f"select name, version, octet_length(bb)::bigint as n_bytes, sha256(bb) as hash from ({PAGES})")
def reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page put together again; pages that share name and version are told apart by timestamp."""
    store = datasets.store(datasets.pages(spark, sf_dir))
    whole = chunking.reassembled(chunking.manifest_chunks(store.manifests, "timestamp"), store.chunks)
    return whole.select("name", "version", F.octet_length("data").cast("bigint").alias("n_bytes"), scalars.digest(F.col("data")).alias("hash"))


@query(cut_sql(DOCUMENTS) + "select b.name, b.version, octet_length(bb)::bigint as n_bytes, sha256(bb) as hash from b where name not in (select name from ch where hash not in (select hash from a))")
def download(spark: SparkSession, sf_dir: str) -> DataFrame:
    node, _ = datasets.two_nodes(spark, sf_dir)
    return retrieve.download(node).select("name", "version", F.octet_length("data").cast("bigint").alias("n_bytes"), scalars.digest(F.col("data")).alias("hash"))


@query(
    cut_sql(DOCUMENTS)
    + """select ch.name, ch.version, count(*)::bigint as num_chunks, sum(case when a.hash is null then 1 else 0 end)::bigint as n_missing,
min(case when a.hash is null then idx end) as first_missing, sum(case when a.hash is null then 0 else n end) = sum(n) as size_ok, bool_and(a.hash is not null) as digest_ok,
case when bool_and(a.hash is not null) then 'ok' else 'missing chunks' end as status from ch left join a on a.hash = ch.hash group by ch.name, ch.version"""
)
def download_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    node, _ = datasets.two_nodes(spark, sf_dir)
    return retrieve.report(node)


@query(cut_sql(DOCUMENTS) + "select distinct hash, n as size from ch where hash not in (select hash from a)")
def upload_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    node, other = datasets.two_nodes(spark, sf_dir)
    return sync.upload_plan(other.chunks, node.chunks)


@query(cut_sql(DOCUMENTS) + "select distinct hash, case when hash in (select hash from a) then 'local' else 'remote' end as source from ch")
def fetch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    node, other = datasets.two_nodes(spark, sf_dir)
    return sync.fetch_plan(other.manifests, node.chunks, other.chunks)


@query(cut_sql(DOCUMENTS) + "select name, version, num_chunks, file_size, ts as timestamp, sha256(list) as list_digest from m union all select name, 2, num_chunks, file_size, ts, sha256(list) from m")
def upload_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = empty_store(spark)
    files = datasets.documents(spark, sf_dir).drop("version")
    once = lifecycle.added(empty, lifecycle.upload(empty, files, datasets.CHUNK))
    twice = lifecycle.added(once, lifecycle.upload(once, files, datasets.CHUNK))
    return listed(twice.manifests)


@query(
    cut_sql(DOCUMENTS)
    + """, lacks as (select distinct name from ch where hash not in (select hash from a))
select m.name, case when name::bigint % 7 = 0 then 'invalid chunk count' when name::bigint % 7 = 1 then 'failed reading chunk list' when name in (select name from lacks) then 'missing chunks' else 'ok' end as status,
case when name::bigint % 7 > 1 and name not in (select name from lacks) then version + 1 end as new_version from m"""
)
def commit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    node, _ = datasets.two_nodes(spark, sf_dir)
    kind = F.col("name").cast("bigint") % 7
    count = F.when(kind == 0, F.lit(5000)).when(kind == 1, F.col("num_chunks") + 1).otherwise(F.col("num_chunks"))
    return lifecycle.commit_status(node, node.manifests.withColumn("num_chunks", count.cast("bigint")))


@query(cut_sql(DOCUMENTS) + "select name, version + 1 as version, num_chunks, file_size, ts as timestamp, sha256(list) as list_digest from m")
def remote_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    node, other = datasets.two_nodes(spark, sf_dir)
    files = datasets.documents(spark, sf_dir).drop("version")
    _, after, _ = sync.remote_upload(node, other, files, datasets.CHUNK)
    return listed(after.manifests).filter(F.col("version") == 2)


@query(f"select name, version, sha256(bb) as hash from ({DOCUMENTS})")
def remote_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    node, other = datasets.two_nodes(spark, sf_dir)
    found, _ = sync.remote_download(node, other, other.manifests)
    return found.select("name", "version", scalars.digest(F.col("data")).alias("hash"))


@query(f"select o_orderkey, {label_sql('floor(o_totalprice * 10)::bigint')} as local_label, {label_sql('floor(o_totalprice * 100000)::bigint', True)} as remote_label from orders")
def size_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = lambda by: F.floor(F.col("o_totalprice") * by).cast("bigint")
    return datasets.table(spark, sf_dir, "orders").select("o_orderkey", scalars.size_label(price(10)).alias("local_label"), scalars.size_label(price(100000), True).alias("remote_label"))


@query(f"select event_id, {time_sql('floor(epoch(ts))::bigint')} as time_label from events")
def time_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.table(spark, sf_dir, "events").select("event_id", scalars.time_label(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("time_label"))


@query(
    r"""with l as (select conv_id * 1000 + turn as seq, case turn % 4 when 0 then '  ping ' || role when 1 then 'History ' || conv_id || ' ' when 2 then 'get_meta ' || conv_id || ' ' || turn else 'nonsense' end as line from conversations),
t as (select seq, trim(line) as line from l where trim(line) <> '')
select seq, upper(regexp_extract(line, '^([^ ]*)', 1)) as verb, regexp_extract(line, '^[^ ]* *(.*)$', 1) as argument, upper(regexp_extract(line, '^([^ ]*)', 1)) in ('PING', 'HISTORY', 'GET_META') as known from t"""
)
def protocol_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, conv = F.col("turn") % 4, F.col("conv_id").cast("string")
    line = F.when(kind == 0, F.concat(F.lit("  ping "), "role")).when(kind == 1, F.concat(F.lit("History "), conv, F.lit(" ")))
    line = line.when(kind == 2, F.concat(F.lit("get_meta "), conv, F.lit(" "), F.col("turn").cast("string"))).otherwise("nonsense")
    lines = datasets.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), line.alias("line"))
    return protocol.parsed(lines)


@query(cut_sql(PAGES) + "select name, version, sha256('name=' || name || chr(10) || 'version=' || version || chr(10) || 'chunks=' || num_chunks || chr(10) || 'size=' || file_size || chr(10) || 'timestamp=' || ts || chr(10) || (select string_agg('hash.' || idx || '=' || hash, chr(10) order by idx) from ch where ch.name = m.name) || chr(10)) as text_digest from m")
def meta_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each page's manifest. Pages of one name list the chunks of all of them, by place; pages that share a place, which the SQL leaves open, by timestamp."""
    store = datasets.store(datasets.pages(spark, sf_dir))
    return metatext.lines_of(metatext.by_name(store.manifests)).select("name", "version", F.sha2("text", 256).alias("text_digest"))


@query(cut_sql(PAGES) + "select name, version, num_chunks, file_size, ts as timestamp, sha256(list) as list_digest from m")
def meta_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's manifest, read from its text: pages may share name and version, so a text's path has its timestamp too."""
    text = metatext.lines_of(datasets.store(datasets.pages(spark, sf_dir)).manifests)
    path = F.concat_ws("/", "name", F.col("version").cast("string"), F.col("timestamp").cast("string"))
    lines = text.select(path.alias("path"), F.posexplode(F.split("text", "\n")).alias("pos", "value"))
    return listed(metatext.parsed(lines))


@query(cut_sql(DOCUMENTS) + "select count(*)::bigint as n_chunks, count(distinct hash)::bigint as n_distinct, sum(n)::bigint as logical_bytes, (select sum(n)::bigint from (select distinct hash, n from ch)) as physical_bytes from ch")
def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond what was asked for: what keeping each chunk once saves."""
    each = chunking.slices(datasets.documents(spark, sf_dir), datasets.CHUNK).groupBy("hash").agg(F.count("*").alias("uses"), F.max("n").alias("n"))
    return each.agg(F.sum("uses").alias("n_chunks"), F.count("*").alias("n_distinct"), F.sum(F.col("uses") * F.col("n")).cast("bigint").alias("logical_bytes"), F.sum("n").cast("bigint").alias("physical_bytes"))


NAMED = f"select lang as name, source || '/' || lang as path, {STAMP} + doc_id % 7 as ts, encode(text) as bb from documents where lang <> '' and source is not null and text is not null"


@query(cut_sql(f"select name, row_number() over (partition by name order by ts, path, sha256(bb)) as version, ts, bb from ({NAMED})") + "select name, version, num_chunks, file_size, ts as timestamp, sha256(list) as list_digest from m")
def upload_same_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one upload, under the base name of its path: its language."""
    rows = datasets.table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "lang").alias("name"), (F.lit(STAMP) + F.col("doc_id") % 7).alias("timestamp"), datasets.payload("text").alias("data"))
    return listed(lifecycle.upload(empty_store(spark), rows, datasets.CHUNK).manifests)


@query(f"select name, version, doc % 5 <> 0 as delivered, case when doc % 5 <> 0 then sha256(bb) end as hash from (select *, name::bigint as doc from ({DOCUMENTS}))")
def remote_download_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receiver whose chunks of some documents are damaged, and a sender whose manifests of some tell a wrong size: what arrives, for each manifest."""
    node, other = datasets.two_nodes(spark, sf_dir)
    spoilt = F.when(F.substring("hash", 1, 1) < "8", F.encode(F.lit("?"), "UTF-8")).otherwise(F.col("data"))
    wrong = F.col("name").cast("bigint") % 5 == 0
    manifests = other.manifests.withColumn("file_size", F.col("file_size") + F.when(wrong, 1).otherwise(0))
    found, _ = sync.remote_download(Store(node.manifests, node.chunks.withColumn("data", spoilt)), other, manifests)
    found = found.select("name", "version", scalars.digest(F.col("data")).alias("hash"))
    return manifests.select("name", "version").join(found, ["name", "version"], "left").select("name", "version", F.col("hash").isNotNull().alias("delivered"), "hash")


@query(cut_sql(DOCUMENTS) + "select hash, any_value(n) as size, sha256(any_value(d)) = hash as sound from ch where hash in (select hash from a) group by hash")
def chunk_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk that one node lists, asked for by upper-case digest where the other has half of them."""
    node, other = datasets.two_nodes(spark, sf_dir)
    found = retrieve.chunks_of(node, other.chunks.select(F.upper("hash").alias("hash")))
    return found.select("hash", "size", (scalars.digest(F.col("data")) == F.col("hash")).alias("sound"))


@query(cut_sql(PAGES.replace("url as name", "cast(page_id as varchar) as name")) + "select m.name, m.version, num_chunks, file_size, sha256(list) as list_digest, ch.hash as first_chunk, ch.n as first_size from m join ch on ch.name = m.name and ch.idx = 0")
def written_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store committed to disk, loaded again, and read: manifests, and the first chunk of each."""
    node = ParquetStore(spark, shared_folder(spark, "store"))
    pages = datasets.pages(spark, sf_dir).select((F.col("timestamp") - STAMP).cast("string").alias("name"), "timestamp", "data")
    store = node.commit(lifecycle.upload(node.load(), pages, datasets.CHUNK))
    first = store.manifests.select("name", "version", "num_chunks", "file_size", F.sha2(F.array_join("chunk_hashes", ","), 256).alias("list_digest"), F.col("chunk_hashes")[0].alias("hash"))
    found = retrieve.chunks_of(store, first).select("hash", scalars.digest(F.col("data")).alias("first_chunk"), F.octet_length("data").cast("bigint").alias("first_size"))
    return first.join(found, "hash").drop("hash")


@query("select page_id || '.v1' as name, octet_length(encode(html))::bigint as n, sha256(encode(html)) as hash, greatest((octet_length(encode(html)) + 1023) // 1024, 1)::bigint as slices from pages")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads written as files slice by slice, and read again: whole files' digests, and the slices of each."""
    folder = shared_folder(spark, "files").removeprefix("file://")
    rows = datasets.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("name"), F.lit(1).alias("version"), datasets.payload("html").alias("data"))
    files.write_payloads(chunking.slices(rows, datasets.CHUNK), folder)
    cut = files.read_slices(spark, folder, datasets.CHUNK).groupBy("path", "name").agg(F.count("*").alias("slices"))
    return files.file_digests(cut, "name", "slices").select("name", "n", "hash", "slices")


ASKED = """, asked as (select c.conv_id * 1000 + c.turn as seq, cast(c.conv_id as varchar) as name, c.turn::bigint as turn, c.role, (c.conv_id + c.turn) % 8 as kind, ch.hash, ch.d, ch.n
from conversations c join ch on ch.name = cast(c.conv_id as varchar) and ch.version = c.turn + 1 and ch.idx = 0),
top as (select name, max(version) as top from m group by name),
meta as (select asked.seq, m.* from asked join top on top.name = asked.name left join m on m.name = asked.name and m.version = case when kind = 5 then top else asked.turn end where kind in (2, 5))
"""


@query(
    cut_sql(CONVERSATIONS)
    + ASKED
    + """select seq, 0::bigint as row, 'PONG ' || role as line from asked where kind = 0
union all select seq, 0, 'OK ' || top || ' versions' from asked join top on top.name = asked.name where kind = 1
union all select seq, m.version, 'v' || m.version || ' ' || file_size || ' ' || num_chunks || ' ' || ts from asked join m on m.name = asked.name where kind = 1
union all select seq, top + 1, 'END' from asked join top on top.name = asked.name where kind = 1
union all select seq, 0, case when name is null then 'ERR File or version not found' else 'OK ' || version || ' ' || file_size || ' ' || num_chunks || ' ' || ts end from meta
union all select seq, idx + 1, hash from meta join ch on ch.name = meta.name and ch.version = meta.version
union all select seq, num_chunks + 1, 'END' from meta where name is not null
union all select seq, 0, 'OK 1' from asked where kind = 3
union all select seq, 0, 'OK ' || n from asked where kind = 4
union all select seq, 1, lower(hex(d)) from asked where kind = 4
union all select seq, 0, 'OK 0' from asked where kind = 6
union all select seq, 0, case when turn % 2 = 0 then 'ERR Unknown command: nonsense' else 'ERR Invalid GET_META arguments' end from asked where kind = 7"""
)
def replies_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command for each turn of the conversations, answered from the store of all of them."""
    turns = datasets.conversations(spark, sf_dir)
    cut = chunking.slices(turns, datasets.CHUNK)
    first = cut.filter(F.col("idx") == 0).select("name", "version", "hash")
    rows = datasets.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").withColumn("name", F.col("conv_id").cast("string")).withColumn("version", F.col("turn") + 1)
    rows = rows.join(first, ["name", "version"])
    kind, turn = (F.col("conv_id") + F.col("turn")) % 8, F.col("turn").cast("string")
    said = lambda verb, *more: F.concat_ws(" ", F.lit(verb), *more)
    line = F.when(kind == 0, said("ping", "role")).when(kind == 1, said("HISTORY", "name")).when(kind == 2, said("get_meta", "name", turn))
    line = line.when(kind == 3, said("HAS_CHUNK", F.upper("hash"))).when(kind == 4, said("GET_CHUNK", "hash")).when(kind == 5, said("GET_META", "name"))
    line = line.when(kind == 6, said("HAS_CHUNK", F.sha2(F.encode(F.concat_ws("/", "name", turn), "UTF-8"), 256)))
    line = line.when(F.col("turn") % 2 == 0, "nonsense").otherwise(said("GET_META", "name", F.lit("--5")))
    return protocol.replies(rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), line.alias("line")), datasets.store(turns))


@query(
    sized_sql(CONVERSATIONS)
    + """, l as (select name, max(version) as versions, arg_max(file_size, version) as latest from m group by name order by name limit 128), c as (select count(*) as n from l), s as (select unnest([1, 2])::bigint as seq)
select seq, 0::bigint as row, 'OK ' || n || ' files' as line from s, c union all select seq, row_number() over (partition by seq order by name), name || ' ' || versions || ' ' || latest from s, l union all select seq, n + 1, 'END' from s, c"""
)
def replies_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIST, asked twice; the wire's cap of 128 names is the feature."""
    asked = spark.createDataFrame([(1, "LIST"), (2, " list ")], "seq bigint, line string")
    manifests = datasets.sized(datasets.conversations(spark, sf_dir))
    return protocol.replies(asked, Store(manifests.withColumn("chunk_hashes", F.lit(None).cast("array<string>")), spark.createDataFrame([], CHUNKS)), verbs=("LIST",))


@query(
    cut_sql(PAGES)
    + """select page_id * 2 + s as seq, 0::bigint as row, case when s = 1 and page_id % 4 = 0 then 'ERR Hash mismatch' when s = 1 and page_id % 4 = 1 then 'ERR Chunk exceeds maximum size'
when s = 1 and page_id % 4 = 2 then 'ERR Invalid STORE_CHUNK format' when s = 1 then 'ERR Missing arguments for STORE_CHUNK' else 'OK' end as line, (select count(distinct hash) from ch where idx = 0)::bigint as added
from pages, (select unnest([0, 1])::bigint as s)"""
)
def replies_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunk of each page sent twice, once in order and once with a fault; and how many chunks the store gets."""
    first = chunking.slices(datasets.pages(spark, sf_dir).withColumn("page_id", F.col("timestamp") - STAMP), datasets.CHUNK).filter(F.col("idx") == 0)
    good = first.select((F.col("page_id") * 2).alias("seq"), F.concat_ws(" ", F.lit("store_chunk"), F.upper("hash"), F.col("n").cast("string")).alias("line"), F.col("data").alias("body"))
    kind, length = F.col("page_id") % 4, F.col("n").cast("string")
    line = F.when(kind == 0, F.concat_ws(" ", F.lit("STORE_CHUNK"), F.reverse("hash"), length)).when(kind == 1, F.concat_ws(" ", F.lit("STORE_CHUNK"), "hash", F.lit("4194305")))
    line = line.when(kind == 2, F.concat_ws(" ", F.lit("STORE_CHUNK"), "hash", F.lit("²"))).otherwise("STORE_CHUNK")
    bad = first.select((F.col("page_id") * 2 + 1).alias("seq"), line.alias("line"), F.col("data").alias("body"))
    told, new = protocol.stored(good.unionByName(bad), empty_store(spark))
    added = new.groupBy(F.lit("all").alias("of")).agg(F.count("*").alias("added"))  # one row
    return told.withColumn("of", F.lit("all")).join(F.broadcast(added), "of").drop("of")


@query(
    cut_sql(DOCUMENTS)
    + """, lacks as (select distinct name from ch where hash not in (select hash from a)),
s as (select m.*, name::bigint * 2 + s as seq, s, name::bigint % 7 as kind, name in (select name from lacks) as lacking from m, (select unnest([0, 1])::bigint as s))
select seq, 0::bigint as row, case when kind = 0 then 'ERR Invalid chunk count' when kind = 1 then 'ERR Failed reading chunk list' when kind = 2 and s = 0 then 'ERR Invalid UPLOAD_META format' when lacking then 'ERR Incomplete upload: missing chunks'
else 'OK ' || (version + case when kind = 2 then 1 else s + 1 end) end as line from s"""
)
def replies_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of each document sent twice to a node that has half of the chunks, some with faults."""
    node, _ = datasets.two_nodes(spark, sf_dir)
    rows = node.manifests.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("s"))
    kind = F.col("name").cast("bigint") % 7
    many = F.when(kind == 0, F.lit(5000)).otherwise(F.col("num_chunks")).cast("string")
    length = F.when((kind == 2) & (F.col("s") == 0), "--5").otherwise(F.col("file_size").cast("string"))
    lines = F.transform("chunk_hashes", lambda h: F.upper(h))
    lines = F.when(kind == 1, lines).otherwise(F.concat(lines, F.array(F.lit("end"))))
    asked = rows.select((F.col("name").cast("bigint") * 2 + F.col("s")).alias("seq"), F.concat_ws(" ", F.lit("UPLOAD_META"), "name", length, many).alias("line"), "timestamp", lines.alias("lines"))
    return protocol.uploaded(asked, node)[0]

"""The engine's own queries, by name, with their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.functions.filters import BloomPolicy
from tidemark.operators import batches, files, layout, reads
from tidemark.plans.fixtures import BATCH, FILE_KEYS, event_log, file_table, loose_files, order_run, part_run, sql, table, user_key
from tidemark.runtime import fresh_path, keep
from tidemark.sources import logfile, tablefile
from tidemark.sources.editfile import Version, VersionEdit
from tidemark.sources.store import Store, StoreOptions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

SNAPSHOT, RETAINED = 6000, [2000, 6000]
POINT_KEY, LOW, HIGH, PREFIX = "u000007", "u000003", "u000012", "u00000"
PROBE_SEQS = [500, 3000, 9000]


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its own name, with its SQL if it has one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


NEWEST = f"SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS k FROM e WHERE seq <= {SNAPSHOT}"
VISIBLE = "SELECT user_key, seq, vtype, value FROM newest WHERE k = 1 AND vtype = 1"
_SNAP = {"newest": NEWEST, "visible": VISIBLE}


def _visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.snapshot_read(event_log(spark, sf_dir), SNAPSHOT)


# -- reads and scans


@query(sql("SELECT * FROM visible", "e", **_SNAP))
def snapshot_read(spark, sf_dir):
    return _visible(spark, sf_dir)


@query(sql(f"SELECT * FROM visible WHERE user_key = '{POINT_KEY}'", "e", **_SNAP))
def point_get(spark, sf_dir):
    return reads.point_get(event_log(spark, sf_dir), POINT_KEY, SNAPSHOT)


@query(sql("SELECT v.* FROM visible v WHERE v.user_key IN (SELECT k FROM keys)", "e", **_SNAP, keys="SELECT 'u' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS k FROM customer"))
def multi_get(spark, sf_dir):
    return reads.multi_get(event_log(spark, sf_dir), _customers(spark, sf_dir), SNAPSHOT)


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(user_key("c_custkey").alias("user_key")).distinct()


@query(sql("SELECT p.user_key, p.probe_seq, e.seq, e.value FROM p ASOF JOIN e ON p.user_key = e.user_key AND p.probe_seq >= e.seq WHERE e.vtype = 1", "e", p=f"SELECT DISTINCT user_key, CAST(unnest({PROBE_SEQS}) AS BIGINT) AS probe_seq FROM e"))
def as_of_get(spark, sf_dir):
    log = event_log(spark, sf_dir)
    probes = log.select("user_key").distinct().select("user_key", F.explode(F.array(*(F.lit(s).cast("long") for s in PROBE_SEQS))).alias("probe_seq"))
    return reads.as_of_get(log, probes)


_CUSTOMERS = "SELECT DISTINCT 'u' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS user_key FROM customer"


@query(sql("SELECT user_key FROM c WHERE user_key IN (SELECT user_key FROM visible)", "e", **_SNAP, c=_CUSTOMERS))
def key_exists(spark, sf_dir):
    return reads.existing(_customers(spark, sf_dir), _visible(spark, sf_dir))


@query(sql("SELECT user_key FROM c WHERE user_key NOT IN (SELECT user_key FROM visible)", "e", **_SNAP, c=_CUSTOMERS))
def key_missing(spark, sf_dir):
    return reads.missing(_customers(spark, sf_dir), _visible(spark, sf_dir))


@query(sql("SELECT *, row_number() OVER (ORDER BY user_key) AS position FROM visible", "e", **_SNAP))
def scan_forward(spark, sf_dir):
    return reads.scan(event_log(spark, sf_dir), SNAPSHOT)


@query(sql("SELECT *, row_number() OVER (ORDER BY user_key DESC) AS position FROM visible", "e", **_SNAP))
def scan_backward(spark, sf_dir):
    return reads.scan(event_log(spark, sf_dir), SNAPSHOT, backward=True)


@query(sql("SELECT min(user_key) AS first_key, arg_min(value, user_key) AS first_value, max(user_key) AS last_key, arg_max(value, user_key) AS last_value FROM visible", "e", **_SNAP))
def first_last(spark, sf_dir):
    return reads.first_last(_visible(spark, sf_dir))


@query(sql(f"SELECT * FROM visible WHERE user_key >= '{LOW}x' ORDER BY user_key LIMIT 1", "e", **_SNAP))
def seek_ge(spark, sf_dir):
    return reads.seek(_visible(spark, sf_dir), f"{LOW}x")


@query(sql(f"SELECT * FROM visible WHERE user_key < '{HIGH}' ORDER BY user_key DESC LIMIT 1", "e", **_SNAP))
def seek_lt(spark, sf_dir):
    return reads.seek_before(_visible(spark, sf_dir), HIGH)


@query(sql(f"SELECT * FROM visible WHERE user_key >= '{LOW}' AND user_key < '{HIGH}'", "e", **_SNAP))
def range_scan(spark, sf_dir):
    return reads.range_scan(event_log(spark, sf_dir), LOW, HIGH, SNAPSHOT)


@query(sql(f"SELECT * FROM visible WHERE starts_with(user_key, '{PREFIX}')", "e", **_SNAP))
def prefix_scan(spark, sf_dir):
    return reads.prefix_scan(event_log(spark, sf_dir), PREFIX, SNAPSHOT)


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'https://m.')")
def prefix_scan_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(F.startswith("url", F.lit("https://m."))).select("page_id", "url")


@query(sql("SELECT user_key, lag(user_key) OVER (ORDER BY user_key) AS prev_key, lead(user_key) OVER (ORDER BY user_key) AS next_key FROM visible", "e", **_SNAP))
def cursor_next_prev(spark, sf_dir):
    return reads.neighbours(_visible(spark, sf_dir))


@query(sql("SELECT user_key, seq, vtype, value, seq % 3 AS run_id, row_number() OVER (ORDER BY user_key, seq DESC, seq % 3) AS position FROM e", "e"))
def merge_runs(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("run_id", F.col("seq") % 3)
    return reads.merge_runs(*(log.where(F.col("run_id") == i) for i in range(3)))


@query(sql("SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC, vtype DESC) AS version FROM e", "e"))
def internal_scan(spark, sf_dir):
    return reads.internal_scan(event_log(spark, sf_dir))


_LEVELLED = "SELECT *, CASE WHEN seq > 4000 THEN 0 WHEN seq > 1500 THEN 1 ELSE 2 END::BIGINT AS level FROM e"


@query(sql(f"SELECT user_key, seq, level, value FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY level, seq DESC) AS k FROM v WHERE seq <= {SNAPSHOT}) WHERE k = 1 AND vtype = 1", "e", v=_LEVELLED))
def get_with_level(spark, sf_dir):
    log = event_log(spark, sf_dir)
    level = F.when(F.col("seq") > 4000, 0).when(F.col("seq") > 1500, 1).otherwise(2).cast("long")
    return reads.get_with_level(log.withColumn("level", level), SNAPSHOT)


@query(sql("SELECT count(CASE WHEN n > 1 THEN 1 END) AS duplicated, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows FROM (SELECT count(*) AS n FROM e GROUP BY user_key, seq)", "e"))
def dup_internal_keys(spark, sf_dir):
    return reads.duplicate_versions(event_log(spark, sf_dir))


@query(sql("SELECT user_key, value, row_number() OVER (ORDER BY user_key) AS position FROM (SELECT user_key, arg_min(value, seq) AS value FROM e GROUP BY user_key)", "e"))
def distinct_sorted(spark, sf_dir):
    return reads.distinct_sorted(event_log(spark, sf_dir))


_BANDS = "SELECT *, (CASE WHEN seq > 2000 THEN 1 ELSE 0 END + CASE WHEN seq > 6000 THEN 1 ELSE 0 END) AS band FROM e"
_KEPT = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_key, band ORDER BY seq DESC) AS k FROM b) WHERE k = 1"


@query(sql("SELECT user_key, seq, vtype, value FROM kept x WHERE vtype = 1 OR EXISTS (SELECT 1 FROM kept y WHERE y.user_key = x.user_key AND y.seq < x.seq AND y.vtype = 1)", "e", b=_BANDS, kept=_KEPT))
def compact_table(spark, sf_dir):
    return reads.compact(event_log(spark, sf_dir), RETAINED)


@query(sql("SELECT max(seq) AS last_seq FROM e", "e"))
def recover_max_seq(spark, sf_dir):
    return event_log(spark, sf_dir).agg(F.max("seq").alias("last_seq"))


def _varint(x: str) -> str:
    return f"CASE WHEN {x} < 128 THEN 1 WHEN {x} < 16384 THEN 2 WHEN {x} < 2097152 THEN 3 WHEN {x} < 268435456 THEN 4 ELSE 5 END"


_KEYLEN, _VALLEN = "strlen(user_key)", "strlen(coalesce(value, ''))"


@query(sql(f"SELECT CAST(sum({_varint(f'({_KEYLEN} + 8)')} + {_KEYLEN} + 8 + {_varint(_VALLEN)} + {_VALLEN}) AS BIGINT) AS n_bytes, count(*) AS n_entries FROM e", "e"))
def memtable_bytes(spark, sf_dir):
    return event_log(spark, sf_dir).agg(F.sum(layout.entry_bytes(F.col("user_key"), F.col("value"))).alias("n_bytes"), F.count("*").alias("n_entries"))


# -- batches


def _batches(spark, sf_dir):
    return batches.as_batches(event_log(spark, sf_dir), BATCH)


_B = {"x": f"SELECT *, (seq - 1) // {BATCH} AS batch_id FROM e"}


@query(sql("SELECT batch_id, count(CASE WHEN vtype = 1 THEN 1 END) AS puts, count(CASE WHEN vtype = 0 THEN 1 END) AS deletes FROM x GROUP BY batch_id", "e", **_B))
def batch_put_delete(spark, sf_dir):
    return batches.put_delete_counts(_batches(spark, sf_dir))


@query(sql("SELECT batch_id, min(seq) OVER w + row_number() OVER (PARTITION BY batch_id ORDER BY seq) - 1 AS seq, vtype, user_key, value FROM x WINDOW w AS (PARTITION BY batch_id)", "e", **_B))
def batch_explode(spark, sf_dir):
    return batches.explode_batches(_batches(spark, sf_dir))


@query(sql("SELECT batch_id, min(seq) AS base_seq, count(*) AS n_ops FROM x GROUP BY batch_id", "e", **_B))
def batch_headers(spark, sf_dir):
    return batches.headers(_batches(spark, sf_dir))


_OP = f"1 + {_varint(_KEYLEN)} + {_KEYLEN} + CASE WHEN vtype = 1 THEN {_varint(_VALLEN)} + {_VALLEN} ELSE 0 END"
_SIZES = f"SELECT batch_id, CAST(12 + sum({_OP}) AS BIGINT) AS n_bytes FROM x GROUP BY batch_id"


@query(sql(_SIZES, "e", **_B))
def batch_size(spark, sf_dir):
    return batches.sizes(batches.explode_batches(_batches(spark, sf_dir)))


@query(sql("SELECT batch_id // 2 AS batch_id, min(CASE WHEN batch_id % 2 = 0 THEN seq END) OVER (PARTITION BY batch_id // 2) + row_number() OVER (PARTITION BY batch_id // 2 ORDER BY batch_id % 2, seq) - 1 AS seq, vtype, user_key, value FROM x", "e", **_B))
def batch_append(spark, sf_dir):
    ops = batches.explode_batches(_batches(spark, sf_dir))
    half = F.floor(F.col("batch_id") / 2)
    even, odd = (ops.where(F.col("batch_id") % 2 == i).withColumn("batch_id", half) for i in (0, 1))
    return batches.append(even, odd)


_QUEUE = f"SELECT batch_id % 8 AS writer, batch_id, CAST(n_bytes * (1 + batch_id % 40) AS BIGINT) AS n_bytes, row_number() OVER (PARTITION BY batch_id % 8 ORDER BY batch_id) AS i FROM ({_SIZES})"
_LIMIT = "CASE WHEN q.n_bytes <= 131072 THEN q.n_bytes + 131072 ELSE 1048576 END"


@query(
    sql(
        "SELECT writer, batch_id, group_no FROM f",
        "e",
        recursive=True,
        **_B,
        q=_QUEUE,
        f=f"SELECT writer, batch_id, i, CAST(0 AS BIGINT) AS group_no, n_bytes AS held, {_LIMIT} AS lim FROM q WHERE i = 1 UNION ALL SELECT q.writer, q.batch_id, q.i, CASE WHEN f.held + q.n_bytes > f.lim THEN f.group_no + 1 ELSE f.group_no END, CASE WHEN f.held + q.n_bytes > f.lim THEN q.n_bytes ELSE f.held + q.n_bytes END, CASE WHEN f.held + q.n_bytes > f.lim THEN {_LIMIT} ELSE f.lim END FROM f JOIN q ON q.writer = f.writer AND q.i = f.i + 1",
    )
)
def group_commit(spark, sf_dir):
    sizes = batches.sizes(batches.explode_batches(_batches(spark, sf_dir)))
    queued = sizes.select((F.col("batch_id") % 8).alias("writer"), "batch_id", (F.col("n_bytes") * (1 + F.col("batch_id") % 40)).alias("n_bytes"))
    return batches.group_commits(queued)


# -- log framing

_RECORDS = f"SELECT batch_id // 50 AS log, batch_id AS rec_id, CAST(n_bytes * (1 + batch_id % 9) AS BIGINT) AS n_bytes FROM ({_SIZES})"


def _records(spark, sf_dir):
    sizes = batches.sizes(batches.explode_batches(_batches(spark, sf_dir)))
    return sizes.select(F.floor(F.col("batch_id") / 50).alias("log"), F.col("batch_id").alias("rec_id"), (F.col("n_bytes") * (1 + F.col("batch_id") % 9)).alias("n_bytes"))


# Within a log, "pos" is where the next header may stand; a fragment a step.
_STEP_PAD = "CASE WHEN 32768 - pos % 32768 < 7 THEN pos + 32768 - pos % 32768 ELSE pos END"


@query(
    sql(
        "SELECT log, rec_id, max(n) AS n_fragments, min(start) AS \"offset\" FROM f WHERE n > 0 GROUP BY log, rec_id",
        "e",
        recursive=True,
        **_B,
        q=f"SELECT *, row_number() OVER (PARTITION BY log ORDER BY rec_id) AS i FROM ({_RECORDS})",
        f="SELECT log, rec_id, i, CAST(0 AS BIGINT) AS n, n_bytes AS remaining, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS start FROM q WHERE i = 1"
        f" UNION ALL SELECT s.log, s.rec_id, s.i, s.n + 1, s.remaining - least(s.remaining, 32768 - s.p % 32768 - 7), s.p + 7 + least(s.remaining, 32768 - s.p % 32768 - 7), coalesce(s.start, s.p) FROM (SELECT f.log, coalesce(q.rec_id, f.rec_id) AS rec_id, coalesce(q.i, f.i) AS i, CASE WHEN q.i IS NULL THEN f.n ELSE 0 END AS n, coalesce(q.n_bytes, f.remaining) AS remaining, CASE WHEN q.i IS NULL THEN f.start END AS start, {_STEP_PAD} AS p FROM f LEFT JOIN q ON f.remaining = 0 AND q.log = f.log AND q.i = f.i + 1 WHERE f.remaining > 0 OR q.i IS NOT NULL) s",
    )
)
def wal_fragment_count(spark, sf_dir):
    return layout.log_fragments(_records(spark, sf_dir))


_FRAGMENTS = "SELECT batch_id // 50 AS log, (batch_id % 50) * 3 + j AS fragment_no, CASE WHEN batch_id % 3 = 0 THEN 'full' WHEN j = 0 THEN 'first' WHEN j = 2 OR (j = 1 AND batch_id % 3 = 1) THEN 'last' ELSE 'middle' END AS kind, n_bytes + j AS n_bytes, batch_id % 11 <> 5 OR j <> 1 AS ok FROM z, (SELECT unnest([0, 1, 2]) AS j) WHERE j <= batch_id % 3"


@query(
    sql(
        "SELECT log, start, n_bytes FROM (SELECT log, min(fragment_no) AS start, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, bool_and(ok) AS fine FROM (SELECT *, fragment_no // 3 AS rec FROM t) GROUP BY log, rec) WHERE fine",
        "e",
        **_B,
        z=_SIZES,
        t=_FRAGMENTS,
    )
)
def wal_reassemble(spark, sf_dir):
    sizes = batches.sizes(batches.explode_batches(_batches(spark, sf_dir)))
    b, j = F.col("batch_id"), F.col("j")
    rows = sizes.withColumn("j", F.explode(F.sequence(F.lit(0), (b % 3).cast("int"))))
    kind = F.when(b % 3 == 0, "full").when(j == 0, "first").when((j == 2) | ((j == 1) & (b % 3 == 1)), "last").otherwise("middle")
    fragments = rows.select(F.floor(b / 50).alias("log"), ((b % 50) * 3 + j).alias("fragment_no"), kind.alias("kind"), (F.col("n_bytes") + j).alias("n_bytes"), ((b % 11 != 5) | (j != 1)).alias("ok"))
    return layout.reassembled(fragments)


# -- layout


@query(sql("SELECT file, user_key, k - 1 AS place, (k - 1) % 16 = 0 AS restart FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY user_key) AS k FROM n)", "n"))
def block_restarts(spark, sf_dir):
    return layout.restarts(part_run(spark, sf_dir))


_SHARED = "CASE WHEN (k - 1) % 16 = 0 THEN 0 ELSE CAST(len(list_filter(range(1, least(length(b), length(user_key)) + 1), lambda i: left(b, i) = left(user_key, i))) AS BIGINT) END"
_PREVIOUS = "SELECT *, row_number() OVER (PARTITION BY file ORDER BY user_key) AS k, lag(user_key) OVER (PARTITION BY file ORDER BY user_key) AS b FROM {0}"


@query(sql("SELECT file, user_key, shared, length(user_key) - shared AS non_shared FROM s", "n", p=_PREVIOUS.format("n"), s=f"SELECT *, {_SHARED} AS shared FROM p"))
def block_prefix_lengths(spark, sf_dir):
    return layout.prefix_lengths(part_run(spark, sf_dir))


# A fold over entries: at a block's first entry and at restarts nothing is shared.
_COMMON = "CAST(len(list_filter(range(1, 11), lambda i: left(p.b, i) = left(p.user_key, i))) AS BIGINT)"
_BLOCKS = (
    "SELECT file, k, user_key, CAST(0 AS BIGINT) AS block, CAST(1 AS BIGINT) AS n, 3 + length(user_key) + length(value) AS size FROM p WHERE k = 1"
    " UNION ALL SELECT file, k, user_key, CASE WHEN shut THEN block + 1 ELSE block END, CASE WHEN shut THEN 1 ELSE n + 1 END, CASE WHEN shut THEN 3 + length(user_key) + length(value) ELSE size + 3 + length(user_key) + length(value) - CASE WHEN n % 16 = 0 THEN 0 ELSE common END END"
    f" FROM (SELECT p.file, p.k, p.user_key, p.value, f.block, f.n, f.size, {_COMMON} AS common, f.size + 4 * (1 + (f.n - 1) // 16) + 4 >= 4096 AS shut FROM f JOIN p ON p.file = f.file AND p.k = f.k + 1)"
)
_O = {"p": _PREVIOUS.format("o"), "f": _BLOCKS}
_BLOCK_ROWS = "SELECT file, block, max(n) AS n_entries, CAST(max(size) + 4 * (1 + (max(n) - 1) // 16) + 4 AS BIGINT) AS n_bytes, min(user_key) AS first_key, max(user_key) AS last_key FROM f GROUP BY file, block"


@query(sql(_BLOCK_ROWS, "o", recursive=True, **_O))
def block_layout(spark, sf_dir):
    return layout.block_layout(order_run(spark, sf_dir))


def _separator(a: str, b: str) -> str:
    n = f"CAST(len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: left({a}, i) = left({b}, i))) AS BIGINT)"
    x, y = f"ascii(substr({a}, {n} + 1, 1))", f"ascii(substr({b}, {n} + 1, 1))"
    return f"CASE WHEN {n} < least(length({a}), length({b})) AND {x} + 1 < {y} THEN left({a}, {n}) || chr({x} + 1) ELSE {a} END"


@query(sql(f"SELECT file, block, CASE WHEN nxt IS NULL THEN last_key ELSE {_separator('last_key', 'nxt')} END AS index_key FROM (SELECT *, lead(first_key) OVER (PARTITION BY file ORDER BY block) AS nxt FROM g)", "o", recursive=True, **_O, g=_BLOCK_ROWS))
def index_separators(spark, sf_dir):
    return layout.index_separators(layout.block_layout(order_run(spark, sf_dir)))


@query(sql('SELECT file, block, first_key, CAST(coalesce(sum(n_bytes + 5) OVER (PARTITION BY file ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM g', "o", recursive=True, **_O, g=_BLOCK_ROWS))
def approx_offset(spark, sf_dir):
    return layout.approximate_offsets(layout.block_layout(order_run(spark, sf_dir)))


@query(
    sql(
        'SELECT file, "offset" // 2048 AS filter_no, count(*) AS n_blocks, min(first_key) AS first_key FROM h GROUP BY ALL',
        "o",
        recursive=True,
        **_O,
        g=_BLOCK_ROWS,
        h='SELECT file, first_key, CAST(coalesce(sum(n_bytes + 5) OVER (PARTITION BY file ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM g',
    )
)
def filter_block_groups(spark, sf_dir):
    return layout.filter_groups(approx_offset(spark, sf_dir))


# -- hash, bloom and checksums


def _hash_sql(key: str, length: int = 10) -> str:
    m = codec._M
    h = f"CAST({(layout.FILTER_SEED ^ length * m) % (1 << 32)} AS HUGEINT)"
    byte = "CAST(ascii(substr({0}, {1}, 1)) AS HUGEINT)"
    full = length - length % 4
    for i in range(0, full, 4):
        word = " + ".join(f"{byte.format(key, i + j + 1)} * {1 << (8 * j)}" for j in range(4))
        h = f"(SELECT xor(CAST(q AS BIGINT), CAST(q // 65536 AS BIGINT)) FROM (SELECT (({h} + {word}) * {m}) % 4294967296 AS q))"
    tail = " + ".join(f"{byte.format(key, full + j + 1)} * {1 << (8 * j)}" for j in range(length % 4))
    return f"(SELECT xor(CAST(q AS BIGINT), CAST(q // 16777216 AS BIGINT)) FROM (SELECT (({h} + {tail}) * {m}) % 4294967296 AS q))"


_HASHED = f"SELECT file, user_key, {_hash_sql('user_key')} AS h FROM o"


@query(sql("SELECT user_key, h AS hash FROM hashed", "o", hashed=_HASHED))
def key_hash(spark, sf_dir):
    return order_run(spark, sf_dir).select("user_key", codec.byte_hash_column(F.col("user_key"), 10, layout.FILTER_SEED).alias("hash"))


_NBITS = "SELECT file, CAST(ceil(greatest(64, count(*) * 10) / 8.0) * 8 AS BIGINT) AS n_bits FROM o GROUP BY file"
_BITS = "SELECT DISTINCT file, n_bits, CAST((h + i * ((h >> 7) | (h << 15))) % n_bits AS BIGINT) AS bit FROM (SELECT * FROM hashed JOIN nb USING (file)), (SELECT unnest(range(6)) AS i)"
_BLOOM = {"hashed": _HASHED, "nb": _NBITS, "bits": _BITS}


@query(sql("SELECT file, n_bits, bit FROM bits", "o", **_BLOOM))
def bloom_build_bits(spark, sf_dir):
    return layout.bloom_bits(order_run(spark, sf_dir), 10)


_PROBES = "SELECT file, lpad(CAST(seq + 5000000000 AS VARCHAR), 10, '0') AS user_key FROM o UNION ALL SELECT file, user_key FROM o"
_ASKED = f"SELECT DISTINCT file, user_key, CAST((h + i * ((h >> 7) | (h << 15))) % n_bits AS BIGINT) AS bit FROM (SELECT a.file, a.user_key, n_bits, {_hash_sql('a.user_key')} AS h FROM a JOIN nb USING (file)), (SELECT unnest(range(6)) AS i)"
_MAY = "SELECT k.file, k.user_key, count(*) = count(b.bit) AS may_match FROM asked k LEFT JOIN bits b ON b.file = k.file AND b.bit = k.bit GROUP BY k.file, k.user_key"


def _probed(spark, sf_dir):
    run = order_run(spark, sf_dir)
    absent = run.select("file", F.lpad((F.col("seq") + 5_000_000_000).cast("string"), 10, "0").alias("user_key"))
    return layout.bloom_probe(layout.bloom_words(run, 10), absent.unionByName(run.select("file", "user_key")), 10)


@query(sql(_MAY, "o", **_BLOOM, a=_PROBES, asked=_ASKED))
def bloom_probe(spark, sf_dir):
    return _probed(spark, sf_dir)


@query(sql(f"SELECT user_key >= '5' AS absent, count(*) AS n, count(CASE WHEN may_match THEN 1 END) AS n_may FROM ({_MAY}) GROUP BY absent", "o", **_BLOOM, a=_PROBES, asked=_ASKED))
def bloom_fpr(spark, sf_dir):
    return _probed(spark, sf_dir).groupBy((F.col("user_key") >= "5").alias("absent")).agg(F.count("*").alias("n"), F.count(F.when(F.col("may_match"), 1)).alias("n_may"))


@query()
def checksum_verify(spark, sf_dir):
    payload = F.concat("user_key", "value")
    stored = keep(layout.checksums(order_run(spark, sf_dir), payload), "checksums")
    return layout.verified(stored, payload).groupBy("ok").agg(F.count("*").alias("n"))


# -- codecs


@query(sql(f"SELECT user_key, nxt, {_separator('user_key', 'nxt')} AS separator FROM (SELECT file, user_key, lead(user_key) OVER (PARTITION BY file ORDER BY user_key) AS nxt FROM n) WHERE nxt IS NOT NULL", "n"))
def shortest_separator(spark, sf_dir):
    from pyspark.sql import Window

    rows = part_run(spark, sf_dir).select("user_key", F.lead("user_key").over(Window.partitionBy("file").orderBy("user_key")).alias("nxt")).where("nxt is not null")
    return rows.withColumn("separator", codec.separator_column(F.col("user_key"), F.col("nxt")))


@query(sql("SELECT user_key, chr(ascii(user_key) + 1) AS successor FROM n", "n"))
def short_successor(spark, sf_dir):
    return part_run(spark, sf_dir).select("user_key", codec.successor_column(F.col("user_key")).alias("successor"))


@query(sql("SELECT user_key, CAST(CASE WHEN user_key < mark THEN -1 WHEN user_key = mark THEN 0 ELSE 1 END AS BIGINT) AS cmp FROM (SELECT user_key, 'u000010' AS mark FROM e)", "e"))
def key_compare(spark, sf_dir):
    key, mark = F.col("user_key").cast("binary"), F.lit("u000010").cast("binary")
    return event_log(spark, sf_dir).select("user_key", F.when(key < mark, -1).when(key == mark, 0).otherwise(1).cast("long").alias("cmp"))


_SPREAD = "o_orderkey * o_orderkey * 7919"
#: Bytes of the longest varint of a decimal.
WIDEST = 18


@query(f"SELECT o_orderkey, CAST({_varint(_SPREAD)} AS BIGINT) AS n FROM orders")
def varint_len(spark, sf_dir):
    key = F.col("o_orderkey")
    # Products past 63 bits (o_orderkey over 34 million) are decimals.
    past = key > math.isqrt(((1 << 63) - 1) // 7919)
    exact = key.cast("decimal(20,0)") * key.cast("decimal(20,0)") * 7919
    n = F.when(past, codec.varint_length(exact, WIDEST)).otherwise(codec.varint_length(key * key * 7919))
    return table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"))


_WIDE = "CASE " + " ".join(f"WHEN x < {1 << 7 * n} THEN {n}" for n in range(1, 9)) + " ELSE 9 END"


@query(f"SELECT o_orderkey, step, CAST({_WIDE} AS BIGINT) AS n FROM (SELECT o_orderkey, step, (o_orderkey << step) - 1 AS x FROM orders, (SELECT unnest([0, 7, 14, 21, 28, 35, 42]) AS step))")
def varint_widths(spark, sf_dir):
    """Every width a non-negative long can have, and the numbers at its edges; a
    number past 63 bits is a decimal, not a shift that lost its top."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(*(F.lit(7 * i) for i in range(7)))).alias("step"))
    key, step = F.col("o_orderkey"), F.col("step")
    past = key > F.call_function("shiftright", F.lit((1 << 63) - 1), step)
    power = F.call_function("shiftleft", F.lit(1).cast("long"), step).cast("decimal(13,0)")
    exact = key.cast("decimal(19,0)") * power - 1
    n = F.when(past, codec.varint_length(exact, WIDEST)).otherwise(codec.varint_length(F.call_function("shiftleft", key, step) - 1))
    return rows.select("o_orderkey", "step", n.alias("n"))


@query(sql("SELECT user_key, seq, vtype, CAST(CAST(seq AS HUGEINT) * 256 + vtype AS DECIMAL(20, 0)) AS tag FROM e", "e"))
def parse_internal_key(spark, sf_dir):
    packed = event_log(spark, sf_dir).select("user_key", codec.packed_tag(F.col("seq"), F.col("vtype")).alias("tag"))
    seq = F.floor(F.col("tag") / 256).cast("long")
    return packed.select("user_key", seq.alias("seq"), (F.col("tag") - seq.cast("decimal(20,0)") * 256).cast("long").alias("vtype"), "tag")


_NAMES = ["100.log", "0.log", "0.sst", "0.ldb", "CURRENT", "LOCK", "MANIFEST-2", "MANIFEST-7", "LOG", "LOG.old", "18446744073709551615.log", "foo", "foo-dx-100.log", ".log", "", "manifest", "CURREN", "CURRENTX", "MANIFES", "MANIFEST", "MANIFEST-", "XMANIFEST-3", "MANIFEST-3x", "LOC", "LOCKx", "LO", "LOGx", "18446744073709551616.log", "184467440737095516150.log", "100", "100.", "100.lop"]
_NAME_ROWS = ", ".join(f"('{n}')" for n in _NAMES)
_KIND_SQL = "CASE WHEN name IN ('LOG', 'LOG.old') THEN 'info' WHEN name IN ('CURRENT', 'LOCK') THEN lower(name) WHEN name LIKE 'MANIFEST-%' THEN 'manifest' WHEN name LIKE '%.log' THEN 'log' WHEN name LIKE '%.dbtmp' THEN 'temp' ELSE 'table' END"


@query(f"SELECT name, {_KIND_SQL} AS kind, coalesce(nullif(d, ''), '0') AS number FROM (SELECT name, regexp_extract(name, '^(?:MANIFEST-)?([0-9]+)(?:\\.(?:log|sst|ldb|dbtmp))?$', 1) AS d FROM (VALUES {_NAME_ROWS}) t(name)) WHERE regexp_matches(name, '^(CURRENT|LOCK|LOG|LOG\\.old|MANIFEST-[0-9]+|[0-9]+\\.(log|sst|ldb|dbtmp))$') AND CAST(coalesce(nullif(d, ''), '0') AS HUGEINT) < 18446744073709551616")
def parse_file_name(spark, sf_dir):
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, _NAMES))).alias("name"))
    found = names.withColumn("found", codec.file_name_columns(F.col("name"))).where("found is not null")
    return found.select("name", "found.kind", F.col("found.number").cast("string").alias("number"))


@query(sql("SELECT user_key, row_number() OVER (ORDER BY reverse(user_key)) AS position FROM o", "o"))
def scan_reverse_cmp(spark, sf_dir):
    # Reversing characters equals reversing bytes for these ASCII keys.
    rows = order_run(spark, sf_dir).select("user_key", F.reverse("user_key").alias("sort_key"))
    return reads.with_position(rows, "sort_key").select("user_key", "position")


# -- files and manifests


@query(sql(f"SELECT file AS number, min(user_key) AS smallest, max(user_key) AS largest, min(seq) AS smallest_seq, max(seq) AS largest_seq, count(*) AS n_entries, CAST(sum({_varint(f'({_KEYLEN} + 8)')} + {_KEYLEN} + 8 + {_varint(_VALLEN)} + {_VALLEN}) AS BIGINT) AS file_size FROM o GROUP BY file", "o"))
def flush_file_meta(spark, sf_dir):
    return files.flush_meta(order_run(spark, sf_dir), F.col("file"), layout.entry_bytes(F.col("user_key"), F.col("value")))


@query(sql("SELECT level, count(*) AS n_files, CAST(sum(file_size) AS BIGINT) AS n_bytes FROM r GROUP BY level", "r"))
def level_stats(spark, sf_dir):
    return files.level_stats(file_table(spark, sf_dir))


@query(sql("SELECT level, CAST(sum(number + 1) AS BIGINT) AS micros, CAST(sum(file_size) AS BIGINT) AS bytes_read, CAST(sum(file_size // 2) AS BIGINT) AS bytes_written FROM r GROUP BY level", "r"))
def compaction_stats(spark, sf_dir):
    jobs = file_table(spark, sf_dir).select("level", (F.col("number") + 1).alias("micros"), F.col("file_size").alias("bytes_read"), F.floor(F.col("file_size") / 2).alias("bytes_written"))
    return files.compaction_stats(jobs)


@query(sql("SELECT level, round(s, 6) AS score, s >= 1 AS needs_compaction FROM (SELECT level, CASE WHEN level = 0 THEN count(*) / 4.0::DOUBLE ELSE sum(file_size)::DOUBLE / (10485760 * power(10, greatest(level - 1, 0))) END AS s FROM r GROUP BY level)", "r"))
def compaction_score(spark, sf_dir):
    return files.compaction_score(file_table(spark, sf_dir))


@query(sql("SELECT number, greatest(100, file_size // 16384) AS allowed_seeks FROM r", "r"))
def seek_budget(spark, sf_dir):
    return files.seek_budget(file_table(spark, sf_dir))


@query(sql("SELECT n AS n_level0, CASE WHEN n >= 12 THEN 'stop' WHEN n >= 8 THEN 'slow' ELSE 'run' END AS state FROM (SELECT count(CASE WHEN level = 0 THEN 1 END) AS n FROM r)", "r"))
def write_stall_state(spark, sf_dir):
    return files.write_state(file_table(spark, sf_dir))


@query(sql("SELECT user_key, (SELECT arg_min(number, largest) FROM r WHERE largest >= k.user_key) AS number FROM (SELECT DISTINCT lpad(CAST(o_custkey * 37 AS VARCHAR), 10, '0') AS user_key FROM orders) k", "r"))
def find_file(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.lpad((F.col("o_custkey") * 37).cast("string"), 10, "0").alias("user_key")).distinct()
    return files.find_file(file_table(spark, sf_dir), keys)


_RANGES = [(None, None), ("0000000100", "0000000200"), (None, "0000000000"), ("0000099999", None), ("9", None), ("0000001000", "0000001000"), ("a", "b")]
_RANGE_ROWS = ", ".join(f"({'NULL' if a is None else repr(a)}, {'NULL' if b is None else repr(b)})" for a, b in _RANGES)


@query(sql("SELECT lo AS low, hi AS high, EXISTS (SELECT 1 FROM r WHERE (lo IS NULL OR largest >= lo) AND (hi IS NULL OR smallest <= hi)) AS overlaps FROM g", "r", g=f"SELECT CAST(lo AS VARCHAR) AS lo, CAST(hi AS VARCHAR) AS hi FROM (VALUES {_RANGE_ROWS}) t(lo, hi)"))
def overlap_exists(spark, sf_dir):
    return files.overlap_exists(file_table(spark, sf_dir), spark.createDataFrame(_RANGES, "low string, high string"))


_KEYS37 = "SELECT DISTINCT lpad(CAST(o_custkey * 3 AS VARCHAR), 10, '0') AS user_key FROM orders"


@query(sql("SELECT user_key, level, number, row_number() OVER (PARTITION BY user_key ORDER BY level, number DESC) AS turn FROM k JOIN l ON user_key BETWEEN smallest AND largest", "l", k=_KEYS37))
def candidate_files(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.lpad((F.col("o_custkey") * 3).cast("string"), 10, "0").alias("user_key")).distinct()
    return files.candidate_files(loose_files(spark, sf_dir), keys)


@query(sql("SELECT level, number, CAST(sum(fresh) OVER (ORDER BY smallest, number) AS BIGINT) AS island FROM (SELECT *, CASE WHEN coalesce(max(largest) OVER (ORDER BY smallest, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < smallest, true) THEN 1 ELSE 0 END AS fresh FROM l)", "l"))
def l0_overlap_closure(spark, sf_dir):
    return files.overlap_islands(loose_files(spark, sf_dir))


_ASK = "SELECT number AS range_id, smallest AS low, largest AS high FROM l"


@query(
    sql(
        "SELECT range_id, CAST(CASE WHEN n0 = 0 AND n1 = 0 AND b2 <= 20971520 AND n2 = 0 AND b3 <= 20971520 THEN 2 WHEN n0 = 0 AND n1 = 0 AND b2 <= 20971520 THEN 1 ELSE 0 END AS BIGINT) AS level FROM (SELECT range_id, count(CASE WHEN level = 0 THEN 1 END) AS n0, count(CASE WHEN level = 1 THEN 1 END) AS n1, count(CASE WHEN level = 2 THEN 1 END) AS n2, coalesce(sum(CASE WHEN level = 2 THEN file_size END), 0) AS b2, coalesce(sum(CASE WHEN level = 3 THEN file_size END), 0) AS b3 FROM a LEFT JOIN r ON largest >= low AND smallest <= high GROUP BY range_id)",
        "l",
        "r",
        a=_ASK,
    )
)
def pick_output_level(spark, sf_dir):
    ranges = loose_files(spark, sf_dir).select(F.col("number").alias("range_id"), F.col("smallest").alias("low"), F.col("largest").alias("high"))
    return files.output_level(file_table(spark, sf_dir), ranges)


@query(
    sql(
        "SELECT level, number, smallest, largest FROM i WHERE island IN (SELECT island FROM i GROUP BY island HAVING min(smallest) <= '0000000200' AND max(largest) >= '0000000100')",
        "l",
        i="SELECT *, sum(fresh) OVER (ORDER BY smallest, number) AS island FROM (SELECT *, CASE WHEN coalesce(max(largest) OVER (ORDER BY smallest, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < smallest, true) THEN 1 ELSE 0 END AS fresh FROM l)",
    )
)
def overlapping_inputs(spark, sf_dir):
    return files.overlapping_inputs(loose_files(spark, sf_dir), 0, "0000000100", "0000000200")


@query(
    sql(
        "SELECT level, CAST(NULL AS BIGINT) AS number, 'score' AS reason FROM (SELECT level, CASE WHEN level = 0 THEN count(*) / 4.0::DOUBLE ELSE sum(file_size)::DOUBLE / (10485760 * power(10, greatest(level - 1, 0))) END AS s FROM r GROUP BY level) WHERE round(s, 6) >= 1"
        " UNION ALL SELECT level, number, 'seeks' FROM r WHERE number * 90 >= greatest(100, file_size // 16384)",
        "r",
    )
)
def need_compaction(spark, sf_dir):
    base = file_table(spark, sf_dir)
    return files.need_compaction(base, base.select("number", (F.col("number") * 90).alias("seeks")))


@query(sql("SELECT level, largest, number, file_size, row_number() OVER (PARTITION BY level ORDER BY largest, number) AS position FROM r", "r"))
def level_file_index(spark, sf_dir):
    return files.level_index(file_table(spark, sf_dir))


_EDITS = "SELECT number AS edit_id, 'delete' AS action, level, number, file_size, smallest, largest FROM r WHERE number % 3 = 0 UNION ALL SELECT 100000 + number, 'add', level + 1, number, file_size + 1, smallest, largest FROM r WHERE number % 3 = 0 UNION ALL SELECT 200000 + number, 'delete', level + 1, number, file_size, smallest, largest FROM r WHERE number % 6 = 0"
_APPLIED = "SELECT level, number, file_size, smallest, largest FROM (SELECT *, row_number() OVER (PARTITION BY level, number ORDER BY edit_id DESC) AS k FROM (SELECT CAST(-1 AS BIGINT) AS edit_id, 'add' AS action, level, number, file_size, smallest, largest FROM r UNION ALL SELECT edit_id, action, level, number, file_size, smallest, largest FROM ed)) WHERE k = 1 AND action = 'add'"


def _edits(spark, sf_dir):
    base = file_table(spark, sf_dir)
    third, sixth = base.where("number % 3 = 0"), base.where("number % 6 = 0")
    keys = ["level", "number", "file_size", "smallest", "largest"]
    gone = third.select(F.col("number").alias("edit_id"), F.lit("delete").alias("action"), *keys)
    moved = third.withColumn("level", F.col("level") + 1).withColumn("file_size", F.col("file_size") + 1).select((F.lit(100000) + F.col("number")).alias("edit_id"), F.lit("add").alias("action"), *keys)
    back = sixth.withColumn("level", F.col("level") + 1).select((F.lit(200000) + F.col("number")).alias("edit_id"), F.lit("delete").alias("action"), *keys)
    return base, gone.unionByName(moved).unionByName(back)


def _live(spark, sf_dir):
    return files.apply_edits(*_edits(spark, sf_dir))


@query(sql(_APPLIED, "r", ed=_EDITS))
def manifest_apply(spark, sf_dir):
    return _live(spark, sf_dir)


@query(sql("SELECT level, count(*) AS n_files, min(number) AS low, max(number) AS high, CAST(sum(file_size) AS BIGINT) AS n_bytes FROM ap GROUP BY level", "r", ed=_EDITS, ap=_APPLIED))
def manifest_snapshot(spark, sf_dir):
    return _live(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n_files"), F.min("number").alias("low"), F.max("number").alias("high"), F.sum("file_size").alias("n_bytes"))


@query(sql("SELECT DISTINCT number FROM (SELECT number FROM ap UNION ALL SELECT number FROM r WHERE level = 0)", "r", ed=_EDITS, ap=_APPLIED))
def live_files(spark, sf_dir):
    return files.live_numbers(_live(spark, sf_dir), file_table(spark, sf_dir).where("level = 0"))


@query(sql("SELECT DISTINCT number FROM ap WHERE number NOT IN (SELECT number FROM r WHERE number % 5 <> 0)", "r", ed=_EDITS, ap=_APPLIED))
def missing_files(spark, sf_dir):
    return files.missing_files(_live(spark, sf_dir), file_table(spark, sf_dir).where("number % 5 <> 0"))


@query(sql("SELECT DISTINCT number FROM r WHERE number NOT IN (SELECT number FROM ap)", "r", ed=_EDITS, ap=_APPLIED))
def obsolete_files(spark, sf_dir):
    return files.obsolete_files(file_table(spark, sf_dir), _live(spark, sf_dir))


_SHARD = f"SELECT user_key, h // 268435456 AS shard FROM (SELECT user_key, {_hash_sql('user_key')} AS h FROM o)"


@query(sql("SELECT shard, count(*) AS n, CAST(sum(strlen(user_key)) AS BIGINT) AS charge FROM s GROUP BY shard", "o", s=_SHARD))
def shard_charge(spark, sf_dir):
    h = codec.byte_hash_column(F.col("user_key"), 10, layout.FILTER_SEED)
    return order_run(spark, sf_dir).groupBy(F.floor(h / (1 << 28)).alias("shard")).agg(F.count("*").alias("n"), F.sum(F.octet_length("user_key").cast("long")).alias("charge"))


# -- byte formats: written, then read back


def _tables(spark, sf_dir):
    """The event log as table files with snappy frames and filters: their manifest."""
    return tablefile.write_table_files(event_log(spark, sf_dir), compression=tablefile.SNAPPY, policy=BloomPolicy())


def _folder(manifest: DataFrame) -> list[str]:
    return [r.path for r in manifest.select("path").collect()]


@query(sql("SELECT user_key, seq, vtype, CASE WHEN vtype = 1 THEN coalesce(value, '') ELSE '' END AS value FROM e", "e"))
def table_files_read(spark, sf_dir):
    """Every version through prefix-compressed, checked snappy blocks."""
    log = event_log(spark, sf_dir).withColumn("value", F.when(F.col("vtype") == 1, F.col("value")))
    manifest = tablefile.write_table_files(log, compression=tablefile.SNAPPY)
    rows = tablefile.read_table_blocks(spark, _folder(manifest))
    return rows.select(F.col("user_key").cast("string"), "seq", "vtype", F.col("value").cast("string"))


@query(sql("SELECT k.user_key, v.seq, v.value FROM k JOIN visible v USING (user_key)", "e", **_SNAP, k=_CUSTOMERS + " UNION ALL SELECT user_key || 'x' FROM (" + _CUSTOMERS + ")"))
def table_files_get(spark, sf_dir):
    """Point reads through file ranges, filters, index and restart points; keys that
    are not there too."""
    keys = _customers(spark, sf_dir)
    asked = keys.unionByName(keys.select(F.concat("user_key", F.lit("x")).alias("user_key")))
    found = tablefile.get_keys(_tables(spark, sf_dir), asked.select(F.col("user_key").cast("binary")), SNAPSHOT, policy=BloomPolicy())
    return found.select(F.col("user_key").cast("string"), "seq", F.col("value").cast("string"))


@query(sql("SELECT file, block, first_key, \"offset\" FROM (SELECT file, block, first_key, CAST(coalesce(sum(n_bytes + 5) OVER (PARTITION BY file ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM g)", "o", recursive=True, **_O, g=_BLOCK_ROWS))
def table_offset_of(spark, sf_dir):
    """Approximate offsets that a real table's index gives for the first key of each block."""
    run = order_run(spark, sf_dir)
    firsts = layout.block_layout(run).select("file", "block", "first_key")
    return firsts.join(tablefile.offsets_of(run, firsts), ["file", "first_key"]).select("file", "block", "first_key", "offset")


@query(sql(_APPLIED, "r", ed=_EDITS))
def manifest_bytes(spark, sf_dir):
    """The manifest's edits encoded, framed as a log, read back, decoded and folded."""
    base, edits = _edits(spark, sf_dir)
    first = [("add", *r) for r in base.select("level", "number", "file_size", "smallest", "largest").toLocalIterator()]
    later = [tuple(r) for r in edits.orderBy("edit_id", F.desc("action")).select("action", "level", "number", "file_size", "smallest", "largest").toLocalIterator()]
    records = []
    for action, level, number, size, low, high in (*first, *later):
        edit = VersionEdit()
        if action == "add":
            edit.add_file(level, number, size, *(codec.pack_internal_key(k.encode(), number, 1) for k in (low, high)))
        else:
            edit.delete_file(level, number)
        records.append(edit.encode())
    version = Version()
    for record in logfile.read_records(logfile.frame(records)):
        version.apply(VersionEdit.decode(record))
    live = [(level, f.number, f.file_size, f.smallest[:-8].decode(), f.largest[:-8].decode()) for (level, _), f in version.files.items()]
    return spark.createDataFrame(live, "level long, number long, file_size long, smallest string, largest string")


@query(sql("SELECT * FROM visible", "e", **_SNAP))
def store_recover(spark, sf_dir):
    """A store directory of two levels of tables and unflushed logs, recovered from
    its CURRENT file and read as of a snapshot."""
    log = event_log(spark, sf_dir)
    store = Store(spark, fresh_path(spark, "store"), StoreOptions(create_if_missing=True))
    store.add(log.where("seq <= 1500"), 1)
    store.add(log.where("seq > 1500 and seq <= 4000"))
    tail = batches.as_batches(log.where("seq > 4000"), BATCH).withColumn("log", F.lit(store.numbers.new()).cast("long"))
    for row in logfile.write_log_files(tail).collect():
        store.folder.move_in(row.path, codec.file_name("log", row.log))
    again = Store(spark, store.folder.path)
    found = reads.snapshot_read(again.log().drop("file"), SNAPSHOT)
    return found.select(F.col("user_key").cast("string"), "seq", "vtype", F.col("value").cast("string"))

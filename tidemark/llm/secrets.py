"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong spans come from three patterns (assignments, access identifiers, long hex
runs).  Weak candidates - loose identifiers, unlabelled keys, secrets under short
labels, endpoints - are common in clean text, so one is reported only when a complementary part stands in
its scope: the same text, at most ``SCOPE`` code points away.  The link is an
interval join: both sides are binned by ``SCOPE``, weak candidates to their own
and the neighbouring bins, so a join key holds what fits in a few hundred code
points whatever the text.

Positions: Spark's regex functions return matches but not offsets, so a text is
split at the matches too, and running sums of gap and match lengths in code
points give each start and end.  The sums run as a window over the exploded
matches of one row, linear in their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import keep, spare_name

#: Code points between complementary parts.
SCOPE = 200
#: Spans to mask are broadcast up to this many (16 bytes each).
BROADCAST_SPANS = 1_000_000


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_LABELS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: Whose identifier a label names, and short labels of secrets: too common in clean
#: text to report alone.
_OWNERS = "|".join(_either_case(w) for w in ("client", "access", "account", "user", "app", "application", "tenant", "project", "consumer", "customer", "login", "subscription", "key"))
_SHORT = "|".join(_either_case(w) for w in ("pass", "pwd", "pw", "key", "auth", "authorization", "bearer", "credential", "credentials", "signature", "sig"))

#: kind: (pattern, group whose length counts, least length, role, strong).  The
#: order is that of strong kinds in results.  Runs of hex and of access characters
#: are maximal, so a least length inside the pattern drops the same matches.
KINDS: dict[str, tuple[str, int, int, str, bool]] = {
    "assign": (rf"""({_LABELS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "secret", True),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20, "identifier", True),
    "hex": (r"[0-9a-f]{24,}", 0, 24, "secret", True),
    "loose_id": (rf"""(?:{_OWNERS})[_-]?(?:[Kk]ey[_-]?)?(?:[Ii][Dd]|[Nn]ame)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{{4,}}""", 0, 4, "identifier", False),
    "loose_key": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{32,}+={0,2}(?![A-Za-z0-9+/=_-])", 0, 32, "secret", False),
    "endpoint": (r"""(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20"'<>]+""", 0, 5, "endpoint", False),
    "loose_secret": (rf"""(?<![A-Za-z0-9_-])(?:{_SHORT})["']?\x20*[:=]\x20*["']?([^\x00-\x20"'<>,;]{{4,}})""", 1, 4, "secret", False),
}
#: Roles that make a weak candidate of a role worth reporting.
COMPLEMENTS = {"identifier": ("secret",), "secret": ("identifier",), "endpoint": ("secret",)}
_NUMBER = {kind: i for i, kind in enumerate(KINDS)}


def _matches(text: Column, kind: str) -> Column:
    """array<struct<kind, i, gap, size, ok>> of all matches of one kind."""
    pattern, group, least, _, _ = KINDS[kind]
    regex = F.lit(pattern)
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    counted = F.regexp_extract_all(text, regex, F.lit(group)) if group else whole
    zipped = F.arrays_zip(whole.alias("whole"), counted.alias("counted"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("gap"))
    found = F.transform(
        zipped,
        lambda m, i: F.struct(
            F.lit(_NUMBER[kind]).alias("kind"),
            i.cast("long").alias("i"),
            F.length(m["gap"]).cast("long").alias("gap"),
            F.length(m["whole"]).cast("long").alias("size"),
            (F.length(m["counted"]) >= least).alias("ok"),
        ),
    )
    none = F.array().cast("array<struct<kind:int,i:bigint,gap:bigint,size:bigint,ok:boolean>>")
    return F.when(_possible(text, kind), found).otherwise(none)


def _possible(text: Column, kind: str) -> Column:
    """A cheap condition that every text with a match of the kind to report meets.

    Substring tests run many times faster than the patterns.  A weak secret
    counts only beside an identifier, which links it, or an endpoint, which it
    links, so texts without either are not searched.
    """
    labelled = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    if kind == "assign":
        return labelled & F.regexp_like(text, F.lit(r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""))
    if kind == "access":
        return F.contains(text, F.lit("AKIA"))
    if kind == "endpoint":
        return F.contains(text, F.lit("://"))
    if kind == "loose_id":
        return labelled & F.regexp_like(text, F.lit(KINDS["loose_id"][0]))
    if kind in ("loose_key", "loose_secret"):
        partner = F.contains(text, F.lit("AKIA")) | F.contains(text, F.lit("://")) | _possible(text, "loose_id")
        return partner & labelled if kind == "loose_secret" else partner
    return F.regexp_like(text, F.lit(KINDS[kind][0]))


def candidate_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, key, key_two, kind (number), start, end: every strong span and
    weak candidate, at least one row for each row of ``docs`` (kind null if it has
    none).

    Positions are code points, end exclusive.  The keys are two hashes of the text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    every = F.concat(*(_matches(F.col("text"), kind) for kind in KINDS))
    exploded = rows.select("row", "doc_id", F.xxhash64("text").alias("key"), F.xxhash64(F.lit(1), "text").alias("key_two"), F.inline_outer(every))
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(before)
    placed = exploded.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    good = F.col("kind").isNotNull() & F.col("ok")
    return placed.select("row", "doc_id", "key", "key_two", *(F.when(good, F.col(c)).alias(c) for c in ("kind", "start", "end")))


def _role(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, number in _NUMBER.items():
        out = F.when(kind == number, KINDS[name][3]).otherwise(out)
    return out


def link_weak(spans: DataFrame, *, scope: int = SCOPE) -> DataFrame:
    """(row, kind, start, end, partner_kind, partner_start): weak candidates with
    each complementary part in their scope."""
    strong = F.col("kind").isin([_NUMBER[k] for k in KINDS if KINDS[k][4]])
    placed = spans.where("kind is not null").select("row", "kind", "start", "end", _role(F.col("kind")).alias("role"))
    bins = F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))
    weak = placed.where(~strong).withColumn("bin", F.explode(bins))
    parts = placed.select("row", F.col("kind").alias("partner_kind"), F.col("start").alias("partner_start"), F.col("end").alias("partner_end"), F.col("role").alias("partner_role"), F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("bin"))
    fits = F.lit(False)
    for role, others in COMPLEMENTS.items():
        fits = fits | ((F.col("role") == role) & F.col("partner_role").isin(*others))
    close = (F.col("partner_start") <= F.col("end") + scope) & (F.col("partner_end") >= F.col("start") - scope)
    return weak.join(parts, ["row", "bin"]).where(fits & close).select("row", "kind", "start", "end", "partner_kind", "partner_start").distinct()


def _text(kind: Column, start: Column, end: Column) -> Column:
    name = F.element_at(F.array(*map(F.lit, KINDS)), kind + 1)
    return F.concat_ws(":", name, start.cast("string"), end.cast("string"))


def secret_spans(docs: DataFrame, *, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keys, counts of the strong kinds, ``base``
    and ``spans`` (strong ones, and those with linked weak ones), each an array of
    struct<start, kind, end, name> in order of start and then of kind.

    A null or empty text has no spans; a null id stays; rows that repeat are
    reported each; a very long text is one row like any other; other columns are
    ignored; an empty table gives no rows.
    """
    found = keep(candidate_spans(docs, id_col=id_col, text_col=text_col), "secret-spans")
    linked = link_weak(found, scope=scope).select("row", "kind", "start", "end").distinct().withColumn("linked", F.lit(True))
    strong = F.col("kind").isin([_NUMBER[k] for k in KINDS if KINDS[k][4]])
    rows = found.select("row", "doc_id", "key", "key_two", F.when(strong, F.col("kind")).alias("kind"), "start", "end", F.lit(True).alias("base"))
    weak = linked.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("key_two"), "kind", "start", "end", F.lit(False).alias("base"))
    span = F.struct("start", "kind", "end", _text(F.col("kind"), F.col("start"), F.col("end")).alias("name"))
    held = F.col("kind").isNotNull()
    return (
        rows.unionByName(weak)
        .groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("key").alias("key"),
            F.max("key_two").alias("key_two"),
            *(F.count(F.when(F.col("kind") == _NUMBER[k], 1)).alias(f"n_{k}") for k in KINDS if KINDS[k][4]),
            F.sort_array(F.collect_list(F.when(held & F.col("base"), span))).alias("base"),
            F.sort_array(F.collect_list(F.when(held, span))).alias("spans"),
        )
        .drop("row")
    )


def joined_names(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: s["name"]))


def redact(docs: DataFrame, *, mark: str = "[SECRET]", scope: int = SCOPE, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with each run of overlapping or touching spans of the text replaced by
    ``mark``, and ``n_chars``, if there is such a column, counted anew where a text
    changed.

    What is masked hangs on the text alone, so spans are named by a 128-bit hash of
    it: rows with null or repeated ids are masked like any other.  Texts stay where
    they are while the spans are few by count; beyond that only texts that meet a
    necessary condition of some kind are shuffled to their spans.  A null or empty
    text stays; all columns stay, whatever their names; an empty table stays empty.
    """
    one, two, spans, fresh = (spare_name(docs, c) for c in ("_one", "_two", "_spans", "_new"))
    text = F.col(text_col)
    hashes = (F.xxhash64(text), F.xxhash64(F.lit(1), text))
    named = docs.select(F.monotonically_increasing_id().alias("doc_id"), text.alias("text"))
    found = secret_spans(named, scope=scope).where(F.size("spans") > 0)
    bounds = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    found = found.select(F.col("key").alias(one), F.col("key_two").alias(two), bounds.alias(spans)).dropDuplicates([one, two])
    found = keep(found, "redactions")
    few = (found.agg(F.sum(F.size(spans))).first()[0] or 0) <= BROADCAST_SPANS
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(done: Column, span: Column) -> Column:
        gap = F.substring(text, (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int"))
        new = F.when((span["start"] > done["at"]) | (done["out"] == ""), F.concat(done["out"], gap, F.lit(mark))).otherwise(done["out"])
        return F.struct(new.alias("out"), F.greatest(done["at"], span["end"]).alias("at"))

    def finish(done: Column) -> Column:
        return F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))

    def masked(rows: DataFrame, spans_of: DataFrame) -> DataFrame:
        joined = rows.withColumns({f"{one}l": hashes[0], f"{two}l": hashes[1]})
        joined = joined.join(spans_of, (F.col(f"{one}l") == F.col(one)) & (F.col(f"{two}l") == F.col(two)), "left")
        joined = joined.withColumn(fresh, F.when(F.col(spans).isNotNull(), F.aggregate(spans, start, step, finish)))
        found_in = F.col(fresh).isNotNull()
        length = F.when(found_in, F.length(fresh)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType) if length_col in docs.columns else None
        return joined.select(*(F.coalesce(fresh, text).alias(c) if c == text_col else length.alias(c) if c == length_col else F.col(c) for c in docs.columns))

    if few:
        return masked(docs, F.broadcast(found))
    possible = F.lit(False)
    for kind in KINDS:
        possible = possible | _possible(text, kind)
    possible = F.coalesce(possible, F.lit(False))
    return masked(docs.where(possible), found).unionByName(docs.where(~possible))

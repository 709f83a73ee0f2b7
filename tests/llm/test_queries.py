"""The contract queries themselves, over tables with every defined case."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import bpe, decontam, id_files, langid, ngram_join, queries, secrets, token_counts, topk, url_filters, warc
from tidemark.llm import _kernels as K
from tidemark.runtime import keep

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns that the operators themselves make, in some place or other.
CLASHES = ["row", "key", "key_two", "spans", "node", "rank", "score", "lang_pred", "items", "_gone", "_one", "_spans", "_new", "_text", "ids", "n_tokens", "digest", "lane", "block"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def texts():
    r = np.random.default_rng(12)
    words = ["".join(r.choice(["the", "ing", "and", "wh", "er", "ou", "é", "ün"], 3)) for _ in range(300)]
    out = [" ".join(r.choice(words, r.integers(1, 90))) for _ in range(50)]
    out += [" ".join(out[3].split()[:-1]), out[4] + " more", out[5], out[5]]
    out += [None, "", " \n\t ", "12 34 !!", "a", "one two three", "x" * 30_000, " ".join(r.choice(words, 40_000)), "漢字かな " * 50]
    out += ["AKIA" + "A" * 16 + " é password: hunter22 https://x.example/y " + "0123456789abcdef" * 2, "client_id=shop77 pwd = 'open sesame' AKIA", "user_name: bob1 " + "é" * 300 + " key=value1234", "token=abcdef.g"]
    return out


ITEMS = [(1, "one two three"), (1, "four"), (None, "one two"), (7, None), (8, ""), (20, None)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("sf")
    held = texts()
    rows = [(i, t, ["en", "de", None][i % 3], "s", len(t or "")) for i, t in enumerate(held)] + [(None, held[0], "en", None, None), (7, held[7], "de", "s", 1)]
    extra = ", ".join(f"`{c}` string" for c in CLASHES)
    wide = [(*r, *("clash" for _ in CLASHES)) for r in rows]
    spark.createDataFrame(wide, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3).write.parquet(f"{base}/documents.parquet")
    items = [*ITEMS[:-1], (20, " ".join(held[10].split()[:20]) + " " + " ".join(held[11].split()[-9:]))]
    spark.createDataFrame([(*i, "c") for i in items], "item_id long, text string, words string").write.parquet(f"{base}/benchmark.parquet")
    r = random.Random(3)
    html = ["same", None, "", "é" * 700_000, "<p>x</p>" * 40, "same"]
    pages = [(i, r.choice(["http://a.example.com/en/x", "https://www.example.com/en/", "q://net/es/", "x", None, "http://Com?q", "http://" + "a." * 400 + "com/" + "p" * 9000]), html[i % 6]) for i in range(60)] + [(3, "http://net/fr/", "same"), (None, "http://com/", "same")]
    spark.createDataFrame([(*p, "c", 1) for p in pages], "page_id long, url string, html string, digest string, row int").repartition(4).write.parquet(f"{base}/pages.parquet")
    return str(base)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty_dir(spark, sf_dir, tmp_path_factory):
    base = tmp_path_factory.mktemp("none")
    for name in ("documents", "benchmark", "pages"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{base}/{name}.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{base}/embeddings.parquet")
    return str(base)


def counted(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("name", [n for n in queries.queries()])
def test_empty_tables(spark, empty_dir, name):
    assert queries.queries()[name](spark, empty_dir).count() == 0


def test_op2(spark, sf_dir, rows):
    got = {}
    for r in queries.op2_language(spark, sf_dir).collect():
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und")
        got.setdefault(r.doc_id, set()).add((r.lang_pred, r.score))
    assert len(got) == len({i for i, _ in rows}) and all(len(v) == 1 for v in got.values())
    for i, t in rows:
        assert (next(iter(got[i]))[0] == "und") == (not any(c.isalpha() for c in t or "")), t


def brute_mixture(p, w, allowed, rounds=langid.ROUNDS):
    """Expectation-maximisation for one text, as plainly as can be said."""
    share = allowed / allowed.sum()
    for _ in range(rounds):
        part = share * p
        part = part * (w / part.sum(axis=1))[:, None]
        new = part.sum(axis=0) / w.sum()
        moved, share = abs(new - share).max(), new
        if moved < langid.SETTLED:
            break
    return share, float((np.log((share * p).sum(axis=1)) * w).sum())


def test_language_inference_against_brute_force_in_any_split():
    r = np.random.default_rng(6)
    kinds = 5
    likelihood = r.dirichlet(np.full(1 << langid.BITS, 0.02), kinds).T + 1e-9
    model = langid.Model([f"l{i}" for i in range(kinds)], (likelihood / likelihood.sum(axis=0)).astype(np.float32), np.full(kinds, 1 / kinds))
    alphabet = list("abcdefghij klmnop")
    held = ["".join(r.choice(alphabet, r.integers(0, 120))) for _ in range(60)] + ["", "a", "ab", "abc", "x" * 4000]
    expected = []
    for t in held:
        raw = np.frombuffer(t.encode(), np.uint8)
        buckets, n = np.unique(langid.trigrams(raw, np.array([0, len(raw)]))[0], return_counts=True)
        if not len(buckets):
            expected.append((0, 1 / kinds))
            continue
        p, w = model.likelihood[buckets].astype(float), n.astype(float)
        charge = langid.PENALTY * np.log(w.sum() + 1)
        alone = (np.log(p) * w[:, None]).sum(axis=0)
        best, part, fit = alone.argmax(), 1.0, alone.max() - charge
        order = np.argsort(-brute_mixture(p, w, np.ones(kinds))[0], kind="stable")
        for size in range(2, kinds + 1):
            allowed = np.zeros(kinds)
            allowed[order[:size]] = 1
            share, found = brute_mixture(p, w, allowed)
            if found - size * charge > fit:
                best, part, fit = share.argmax(), share.max(), found - size * charge
        expected.append((best, part))
    whole = None
    for step in (1, 7, len(held)):
        parts = [langid.infer(model, *K.string_buffers(pa.array(held[i : i + step]))) for i in range(0, len(held), step)]
        got = [(int(b), float(s)) for best, score in parts for b, s in zip(best, score)]
        whole = whole or got
        assert got == whole  # not a bit hangs on the texts beside it
    assert [b for b, _ in whole] == [b for b, _ in expected]
    assert np.allclose([s for _, s in whole], [s for _, s in expected])


def test_op3(spark, sf_dir, rows):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = collections.defaultdict(set)
    for item, t in ((r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()):
        w = word.findall((t or "").translate(LOWER))
        n = min(8, len(w))
        for a in range(len(w) - n + 1 if n and item is not None else 0):
            windows[tuple(w[a : a + n])].add(str(item))
    expected = collections.Counter()
    for i, t in rows:
        w, hit, found = word.findall((t or "").translate(LOWER)), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        expected[(i, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(found) >= 2)] += 1
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert counted(queries.op3_decontamination(spark, sf_dir), *columns) == expected and any(k[3] for k in expected)
    old, decontam.SLICE_WORDS = decontam.SLICE_WORDS, 5
    try:
        assert counted(queries.op3_decontamination(spark, sf_dir), *columns) == expected
    finally:
        decontam.SLICE_WORDS = old


def test_proximity_against_brute_force(spark):
    r = np.random.default_rng(9)
    held = [" ".join(r.choice(list("abcdefg"), r.integers(0, 40))) for _ in range(40)] + [None, "a b c a b c"]
    phrases = ["a b", "c", "a b c", "g g f", "zz a", "a b"]
    got = collections.Counter((x.doc_id, x.phrase, x.start) for x in decontam.proximity_matches(spark.createDataFrame(list(enumerate(held)), "doc_id long, text string").repartition(3), phrases, 5).collect())
    expected = collections.Counter()
    for i, t in enumerate(held):
        w = (t or "").split()
        for p in phrases:
            wanted = set(p.split())
            for a in range(len(w)):
                if w[a] in wanted and wanted <= set(w[a : a + 5]):
                    expected[(i, p, a)] += 1
    assert got == expected and expected


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(held, k, num):
    """{id: (set size, smallest id of the component)} of (id, text)."""
    sets = [(i, shingles(t, k)) for i, t in held]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, x) in enumerate(sets):
        for j in range(i + 1, len(sets)):
            y = sets[j][1]
            if x and y and 100 * min(len(x), len(y)) >= num * max(len(x), len(y)) and 100 * len(x & y) >= num * len(x | y):
                parent[root(j)] = root(i)
    lows = collections.defaultdict(list)
    for i, (name, _) in enumerate(sets):
        if name is not None:
            lows[root(i)].append(name)
    return collections.Counter((name, len(x), min(lows[root(i)], default=None)) for i, (name, x) in enumerate(sets))


def test_op4(spark, sf_dir, rows):
    expected = components(rows, 4, 85)
    assert counted(queries.op4_ngram_join(spark, sf_dir), "doc_id", "n_shingles", "component_id") == expected


@pytest.mark.parametrize("short", [0, 48])
def test_open_lists_of_many_components(spark, short, monkeypatch):
    """Texts that share a passage but are no copies, some of them copies all the same."""
    monkeypatch.setattr(ngram_join, "SHORT_LIST", short)
    r = random.Random(8)
    passages = [" ".join(f"p{i}w{j}" for j in range(9)) for i in range(12)]
    held = [" ".join(r.sample(passages, r.randrange(1, 4))) for _ in range(120)]
    held += [t + " end" for t in held[:30]]
    held = [(i, t) for i, t in enumerate(held)]
    for k, num in ((4, 85), (5, 60)):
        got = ngram_join.ngram_components(spark.createDataFrame(held, "doc_id long, text string").repartition(4), k=k, num=num)
        assert counted(got, "doc_id", "n_shingles", "component_id") == components(held, k, num)


def test_op5(spark, sf_dir, rows):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    n = sorted(len(library.encode_ordinary(t or "")) for _, t in rows)
    sums = queries.op5_token_counts(spark, sf_dir)
    for r in sums.collect():
        assert (r.n_docs, r.docs_below, r.docs_at_least) == (n.count(r.length), sum(x < r.length for x in n), sum(x >= r.length for x in n))
        assert (r.n_tokens, r.tokens_below, r.truncated_total) == (r.length * r.n_docs, sum(x for x in n if x < r.length), sum(min(x, r.length) for x in n))
    limits = [0, 1, 2, 50, 51, 10**9, 50]
    sums = keep(sums, "sums")
    totals = token_counts.truncated_totals(sums, limits)
    assert {r.context_limit: r.total for r in totals.collect()} == {c: sum(min(x, c) for x in n) for c in limits}
    assert "NestedLoop" not in totals._jdf.queryExecution().toString() and "Cartesian" not in totals._jdf.queryExecution().toString()
    assert [r.total for r in token_counts.truncated_totals(sums.limit(0), [3]).collect()] == [0] and token_counts.truncated_totals(sums, []).count() == 0
    assert token_counts.quantiles(sums.limit(0), [0.5]).count() == 0


def test_op6(spark, sf_dir, rows):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    at, expected, named = 0, {}, collections.Counter()
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [queries.END]
        named[(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        expected.setdefault(i, []).append(at)
        at += len(ids)
    got = queries.op6_token_files(spark, sf_dir).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == named
    starts = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r.start):
        starts[r.doc_id].append(r.start)
    assert {i: s for i, s in starts.items() if len(s) == 1} == {i: s for i, s in expected.items() if len(s) == 1}


def test_op7(spark, sf_dir, rows):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    expected = collections.Counter()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        expected[(i, len(ids), sha(",".join(map(str, ids))), sha(t or ""))] += 1
    assert counted(queries.op7_bpe(spark, sf_dir), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected


def test_long_pieces_are_merged_in_matrix_rounds():
    coder = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    r = np.random.default_rng(2)
    for alphabet in ("a", "ab", "abcdefghij", "aé漢", "ABab", "="):
        for n in (256, 257, 1500):
            text = "".join(r.choice(list(alphabet), n))
            assert coder.encode(text) == library.encode_ordinary(text)


def test_hash_tables_grow():
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(1, 2**63, 50_000).astype(np.uint64))
    table = bpe.HashTable()
    for a in range(0, len(keys), 777):
        table.put(keys[a : a + 777], np.arange(a, min(a + 777, len(keys)), dtype=np.int32))
    assert np.array_equal(table.find(keys), np.arange(len(keys))) and (table.find(keys ^ np.uint64(1 << 63)) == -1).all()


@pytest.mark.parametrize("lower", [True, False])
def test_word_hashes_past_the_table_of_powers(lower, monkeypatch):
    r = np.random.default_rng(4)
    held = ["".join(r.choice(list("abcAé"), n)) for n in (1, 5, 9, 40, 3, 200, 65, 64, 63, 1)]
    raw = np.frombuffer(" ".join(held).encode(), np.uint8)
    starts, ends, _ = K.words(raw, np.array([0, len(raw)]), K.NOT_SPACE)
    whole = K.word_hashes(raw, starts, ends, lower)
    alone = [K.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]), lower)[0] for w in held]
    assert whole.tolist() == alone
    monkeypatch.setattr(K, "SPAN", 64)
    monkeypatch.setattr(K, "_POWERS", K._Powers())
    assert K.word_hashes(raw, starts, ends, lower).tolist() == alone


def test_op8(spark, sf_dir, rows):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = collections.defaultdict(list)
    for r in queries.op8_secrets(spark, sf_dir).collect():
        got[r.doc_id].append(r)
    for i, t in rows:
        t = t or ""
        spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        names = [s[2] for s in sorted(spans)]
        for r in got[i]:
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(n.startswith(k) for n in names) for k in ("assign", "access", "hex"))
            assert r.base_sha256 == sha(",".join(names))
            assert [n for n in r.spans.split(",") if n.split(":")[0] in ("assign", "access", "hex")] == names
    kinds = {n.split(":")[0] for found in got.values() for r in found for n in r.spans.split(",")}
    assert {"endpoint", "loose_id", "loose_secret"} <= kinds


def test_links_against_brute_force(spark):
    """Weak spans of generated texts, linked by a plain double loop."""
    r = random.Random(21)
    parts = ["AKIA" + "Q" * 16, "password=abcdefgh", "f" * 30, "client_id=abc123", "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLE", "postgres://db.example/x", "pwd=letmein", "account-name: shop", "key: zzzz9", "é" * 90, "plain words here", "x" * 150]
    held = [" ".join(r.choice(parts) for _ in range(r.randrange(1, 14))) for _ in range(150)]
    data = spark.createDataFrame([(i, t, "c") for i, t in enumerate(held)], "doc_id long, text string, kind string").repartition(3)
    got = {x.doc_id: [s.name for s in x.spans] for x in secrets.secret_spans(data).collect()}
    kinds = list(secrets.KINDS)
    for i, t in enumerate(held):
        found = []
        for number, (kind, (pattern, group, least, role, strong)) in enumerate(secrets.KINDS.items()):
            found += [(m.start(), number, m.end(), role, strong) for m in re.finditer(pattern, t, re.A) if len(m[group]) >= least]
        names = []
        for start, number, end, role, strong in found:
            near = (o for o in found if o[0] <= end + secrets.SCOPE and o[2] >= start - secrets.SCOPE)
            if strong or any(o[3] in secrets.COMPLEMENTS[role] for o in near):
                names.append((start, number, f"{kinds[number]}:{start}:{end}"))
        assert got[i] == [n for _, _, n in sorted(names)], t


@pytest.mark.parametrize("most", [secrets.BROADCAST_SPANS, 0])
def test_redact_keeps_rows_and_columns(spark, sf_dir, rows, most, monkeypatch):
    monkeypatch.setattr(secrets, "BROADCAST_SPANS", most)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spans = {r.text: r.spans for r in secrets.secret_spans(docs.select(F.monotonically_increasing_id().alias("doc_id"), "text")).join(docs.select(F.xxhash64("text").alias("key"), "text").distinct(), "key").collect()}
    expected = collections.Counter()
    for r in docs.collect():
        out, at = "", 0
        for s in spans.get(r.text) or []:
            if s.start > at or not out:
                out += r.text[at : s.start] + "[SECRET]"
            at = max(at, s.end)
        text = out + r.text[at:] if out else r.text
        expected[(r.doc_id, text, len(text) if out else r.n_chars, r._one, r.key)] += 1
    got = secrets.redact(docs)
    assert got.columns == docs.columns and counted(got, "doc_id", "text", "n_chars", "_one", "key") == expected
    assert any("[SECRET]" in (k[1] or "") for k in expected)


def test_op9(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    low = {}
    for p in pages:
        if p.page_id is not None:
            low[p.html or ""] = min(p.page_id, low.get(p.html or "", p.page_id))
    expected = collections.Counter()
    for p in pages:
        raw = (p.html or "").encode()
        again = p.page_id is not None and p.page_id > low[p.html or ""]
        expected[(p.page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", low[p.html or ""] if again else None)] += 1
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert counted(queries.op9_warc(spark, sf_dir), *columns) == expected
    old, warc.BROADCAST_PAYLOADS = warc.BROADCAST_PAYLOADS, 0
    try:
        assert counted(queries.op9_warc(spark, sf_dir), *columns) == expected
    finally:
        warc.BROADCAST_PAYLOADS = old


def test_long_payloads_go_chunk_by_chunk(spark, sf_dir):
    manifest = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").where("page_id = 3"))
    chunks = sorted(warc.read_archives(manifest).where(F.col("n_bytes") > warc.CHUNK).collect(), key=lambda r: r.chunk_no)
    assert [len(c.data) for c in chunks] == [warc.CHUNK, 1_400_000 - warc.CHUNK] and [c["last"] for c in chunks] == [False, True]
    so_far = hashlib.sha1()
    for c in chunks:
        so_far.update(c.data)
        assert c.digest == base64.b32encode(so_far.digest()).decode()


@pytest.mark.parametrize("lanes", [None, 1, 3])
def test_op10(spark, sf_dir, lanes):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = queries.op10_url_filters(spark, sf_dir) if lanes is None else url_filters.judge(pages, spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string"), lanes=lanes)
    expected = collections.Counter()
    for p in pages.collect():
        rest = p.url.split("://", 1)[1] if p.url and "://" in p.url else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fits = [(len(h + q), h + q, v) for h, q, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(q)]
        best = max(fits) if fits else (0, None, "allow")
        expected[(p.page_id, host, path, best[1], best[2])] += 1
    assert counted(found, "page_id", "host", "path", "rule", "verdict") == expected


def test_topk_skips_blocks_of_other_clusters(spark):
    r = np.random.default_rng(7)
    centres = r.normal(0, 1, (20, 16))
    vectors = [(i, (centres[i % 20] + r.normal(0, 0.05, 16)).astype(np.float32).tolist()) for i in range(6000)]
    data = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(4)
    rows = data.select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    blocks = [topk.Block(*b) for b in topk.build_blocks(rows).collect()]
    assert sum(len(b.ids) for b in blocks) == 6000
    good = {i: np.floor(np.array(v, np.float64) * 1024).astype(np.int64) for i, v in vectors}
    asked = np.arange(0, 6000, 100)
    matrix = np.stack([good[i] for i in asked.tolist()])
    scored = [n for *_, n in topk.best_of(blocks, matrix, asked, 10)]
    assert sum(scored) < 0.2 * len(blocks) * len(asked), (sum(scored), len(blocks))
    got = collections.defaultdict(list)
    for x in topk.top_k(data, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    every = np.stack([good[i] for i in range(6000)])
    for q in asked.tolist():
        scores = every @ good[q]
        order = [i for i in np.lexsort((np.arange(6000), -scores)).tolist() if i != q][:10]
        assert got[q] == [(i, int(scores[i])) for i in order]


def test_topk_over_the_whole_range_of_longs(spark):
    rows = [(100, [5e15, 1.0]), (1, [1.0, 5e15]), (2, [-5e15, 0.0]), (3, [0.25, 0.5]), (4, [9e15, -9e15]), (3, [0.25, 0.5]), (200, []), (5, [1e300, 0.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(x.rank, x.vec_id, x.score) for x in topk.top_k(data, F.col("vec_id") == 100, k=4).orderBy("rank").collect()]
    top, least = 2**63 - 1, -(2**63)

    def whole(v):
        return [max(least, min(top, int(np.floor(x * 1024)) if abs(x) < 1e18 else (top if x > 0 else least))) for x in v]

    q = whole(rows[0][1])
    scores = sorted((-max(least, min(top, sum(a * b for a, b in zip(q, whole(v))))), i) for i, v in rows if i != 100)
    assert got == [(n + 1, i, -s) for n, (s, i) in enumerate(scores[:4])]


def test_token_files_keep_sections_of_many_distinct_ids(monkeypatch):
    monkeypatch.setattr(id_files, "DISTINCT", 1 << 16)
    r = np.random.default_rng(1)
    ids = r.permutation(np.concatenate([np.arange(150_000), r.integers(0, 150_000, 50_000)]))
    found = list(id_files.sections(ids))
    assert len(found) > 1 and np.array_equal(np.concatenate([s for s, _ in found]), ids)
    for part, prior in found:
        assert np.array_equal(id_files.decode_blocks(id_files.encode_blocks(part, prior), prior), part)


def test_carries_run_through_words():
    """A lane whose low is pushed over 2**64 after words of all ones."""
    w = id_files._Writer(1)
    w.lanes, w.words, w.steps = [np.zeros(1, np.uint16)] * 3, [np.array([x], np.uint32) for x in (7, 0xFFFFFFFF, 0xFFFFFFFF)], 3
    w.carried = [(3, np.zeros(1, np.int64))]
    assert np.frombuffer(w.payloads()[0], "<u4")[:3].tolist() == [8, 0, 0]


def test_pipeline_cases(spark, sf_dir, rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    kept = corpus_pipeline.language_id(spark, docs, sf_dir)
    lettered = collections.Counter(t for _, t in rows if any(c.isalpha() for c in t or ""))
    got = collections.Counter(r.text for r in kept.collect())
    assert set(got) <= set(lettered) and None not in got and all(got[t] == lettered[t] for t in got)
    twice = docs.unionByName(docs.where("doc_id = 5"))
    groups = components([(r.doc_id, r.text) for r in twice.collect()], 5, 80)
    expected = collections.Counter(r.doc_id for r in twice.collect() if r.doc_id is None or any(low == r.doc_id for (i, _, low) in groups if i == r.doc_id))
    assert counted(corpus_pipeline.ngram_jaccard_join(spark, twice, sf_dir), "doc_id") == collections.Counter({(k,): n for k, n in expected.items()})
    planted = spark.createDataFrame([(None, "well one TWO three so", "en", "s", 1), (5, "clean", "en", "s", 5), (5, "one two three", "en", "s", 1), (6, None, "en", "s", None)], docs.schema)
    for most in (decontam.BROADCAST_KEYS, 0):
        decontam.BROADCAST_KEYS, old = most, decontam.BROADCAST_KEYS
        left = corpus_pipeline.decontaminate(spark, planted, sf_dir).collect()
        decontam.BROADCAST_KEYS = old
        assert sorted((r.doc_id, r.text) for r in left) == [(5, "clean"), (6, None)]

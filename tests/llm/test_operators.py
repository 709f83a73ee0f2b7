"""The ten operators against brute force on small fixtures, and defined cases."""

import base64
import collections
import hashlib
import io
import re
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, decontam, id_files, langid, ngram_join, secrets, token_counts, topk, url_filters, warc
from tidemark.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_texts():
    r = np.random.default_rng(4)
    words = ["".join(r.choice(list("abcdeé"), r.integers(1, 6))) for _ in range(300)]
    out = [" ".join(r.choice(words, r.integers(1, 120))) for _ in range(60)]
    for i in range(12):  # copies with a few changed words
        w = out[i].split()
        for _ in range(1 + i % 3):
            w[r.integers(len(w))] = f"Changed{i}"
        out.append(" ".join(w))
    out += [out[0]] * 5 + ["one two", "One  two", "one two three", None, "", " \n\t", "漢字 " * 30, "x" * 40_000, "it's 're\n  \u00a0 y"]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(i, t, "en", "s", len(t or ""), 7) for i, t in enumerate(base_texts())] + [(None, "null id here", None, None, None, 7)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80)])
def test_ngram_join(docs, rows, k, num):
    sets = {i: shingles(t, k) for i, t, *_ in rows if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs, k=k, num=num).collect()}
    assert got.pop(None)[1] is None
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}


def test_ngram_join_empty(empty):
    assert ngram_join.ngram_components(empty).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (5, 4), (9, 9), (None, 1), (2, 1), *((i, i + 1) for i in range(100, 120))], "a long, b long")
    got = {r.node: r.component for r in connected_components(links, "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, **{i: 100 for i in range(100, 121)}}


def test_decontamination(spark, docs, rows, empty):
    texts = [t for _, t, *_ in rows]
    items = [(1, texts[3]), (20, texts[5] + " " + texts[6]), (3, "one TWO three"), (4, None), (None, "one two"), (5, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def words(t):
        return word.findall((t or "").translate(LOWER))

    windows = collections.defaultdict(set)
    for item, t in items:
        w = words(t)
        n = min(8, len(w))
        for i in range(len(w) - n + 1 if n and item is not None else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontam.contamination(docs, bench).collect())
    expected = collections.Counter()
    for i, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        expected[(i, len(w), len(hit), tuple(sorted(found)))] += 1
    assert got == expected and any(k[2] for k in expected)
    old, decontam.SLICE_WORDS = decontam.SLICE_WORDS, 3
    try:
        assert collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontam.contamination(docs, bench).collect()) == expected
    finally:
        decontam.SLICE_WORDS = old
    assert decontam.contamination(empty, bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    near = decontam.proximity_matches(spark.createDataFrame([(1, "a x b y a"), (2, "a"), (3, "b"), (4, "a 1 2 3 b")], "doc_id long, text string"), ["b a"], 3)
    assert sorted((r.doc_id, r.start) for r in near.collect()) == [(1, 0), (1, 2)]


def test_bpe(docs, rows, empty):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = {r.doc_id: (r.ids, bytes(r.decoded)) for r in bpe.encode_documents(docs, path).collect()}
    digests = {r.doc_id: r for r in bpe.encode_digests(docs, path).collect()}
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        assert got[i] == (ids, (t or "").encode())
        assert digests[i].n_tokens == len(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_digests(empty, path).count() == 0


def test_bpe_on_odd_text():
    coder = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    r = np.random.default_rng(7)
    pool = [32, 32, 10, 39, 39, *map(ord, "strevlmd "), 0x85, 0xA0, 0x3000, 0xE9, 0x301, 0x4E00, 0x1F600, 0x0660, 0x11DC1]
    for _ in range(300):
        text = "".join(chr(pool[i]) for i in r.integers(0, len(pool), r.integers(0, 60)))
        assert coder.encode(text) == library.encode_ordinary(text), text
        assert coder.decode(coder.encode(text)) == text.encode()


def test_token_counts(spark, docs, rows, empty):
    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    n = sorted(len(library.encode_ordinary(t or "")) for _, t, *_ in rows)
    sums = token_counts.suffix_sums(token_counts.length_histogram(docs, path)).cache()
    got = {r.length: r for r in sums.collect()}
    assert set(got) == set(n)
    for length, r in got.items():
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (n.count(length), sum(x >= length for x in n), sum(x for x in n if x >= length))
        assert r.truncated_total == sum(min(x, length) for x in n)
    limits = [0, 1, 17, 10**6]
    assert {r.context_limit: r.total for r in token_counts.truncated_totals(sums, limits).collect()} == {c: sum(min(x, c) for x in n) for c in limits}
    assert [r.length for r in token_counts.quantiles(sums, [0.5]).collect()] == [n[-(-len(n) // 2) - 1]]
    assert token_counts.suffix_sums(token_counts.length_histogram(empty, path)).count() == 0


def test_id_blocks():
    r = np.random.default_rng(1)
    for n, most in ((0, 9), (1, 9), (5, 2**32 - 1), (8192, 65_535), (20_000, 100_000), (30_000, 2**32 - 1), (9000, 0)):
        ids = np.minimum(r.zipf(1.3, n) if most < 2**31 else r.integers(0, 2**32, n), most)
        prior = id_files.Prior.of(ids)
        blocks = id_files.encode_blocks(ids, prior)
        prior = id_files.Prior.unpack(len(prior.ids), prior.pack())
        assert np.array_equal(id_files.decode_blocks(blocks, prior), ids)
        for i, b in enumerate(blocks):  # blocks stand alone
            assert np.array_equal(id_files.decode_blocks([b], prior), ids[i * id_files.BLOCK : (i + 1) * id_files.BLOCK])
    ids = np.minimum(r.zipf(1.3, 20_000), 100_000)
    prior = id_files.Prior.of(ids)
    for i, (n, crc, payload) in enumerate(id_files.encode_blocks(ids, prior)):
        for at in (2, 10, len(payload) // 2):
            with pytest.raises(id_files.Corrupt):
                id_files.decode_blocks([(n, crc, payload[:at] + bytes([payload[at] ^ 1]) + payload[at + 1 :])], prior)


def test_id_predictions_ahead_are_those_step_by_step():
    r = np.random.default_rng(3)
    lanes, n = id_files.GROUP + 3, 700
    columns = np.where(r.random((lanes, n)) < 0.8, r.integers(0, 4, (lanes, n)) + r.integers(0, 2, (lanes, n)) * 2048, r.integers(0, 2**16, (lanes, n))).astype(np.uint16)
    columns[0], columns[1] = 7, np.arange(n) % 3
    met = id_files._predictions(columns)
    tables, guess = id_files._Tables(lanes), np.empty((2, lanes), np.int32)
    for t, ids in enumerate(np.ascontiguousarray(columns.T).astype(np.int32)):
        sure = tables.look(guess).copy()
        assert np.array_equal(met[:, t], sure | (guess == ids) << 4)
        tables.learn(ids, guess)
    assert met.max() == 31


def test_id_blocks_keep_their_bytes():
    """Payloads as version 3 has had them from the first."""
    r = np.random.default_rng(2)
    ids = np.minimum(r.zipf(1.3, 50_000), 100_000)
    ids[10_000:30_000] = np.tile(ids[:100], 200)
    payloads = b"".join(p for _, _, p in id_files.encode_blocks(ids, id_files.Prior.of(ids)))
    assert (len(payloads), zlib.crc32(payloads)) == (28_992, 3_047_297_770)


def test_id_blocks_are_below_order_0_and_zlib():
    r = np.random.default_rng(5)
    # Documents of 300 words, each in one of four languages of 500 words, as in prose.
    words = [np.minimum(r.zipf(1.3, r.integers(1, 4)) + r.integers(0, 40), 2500) for _ in range(2000)]
    ids = np.concatenate([words[500 * (d % 4) + w] for d in range(600) for w in r.integers(0, 500, 300)])
    _, counts = np.unique(ids, return_counts=True)
    order_0 = -(counts * np.log2(counts / len(ids))).sum() / 8
    out = io.BytesIO()
    writer = id_files.IdFileWriter(out)
    writer.add([1], ids, np.array([len(ids)]))
    writer.finish()
    assert len(out.getvalue()) < order_0 and len(out.getvalue()) < len(zlib.compress(ids.astype("<u2").tobytes(), 6))


def test_id_file_takes_all_unsigned_32_bit_ids_and_no_others():
    out = io.BytesIO()
    writer = id_files.IdFileWriter(out)
    ids = np.array([0, 70_000, 2**32 - 1, 5])
    writer.add([3, None], ids, np.array([1, 3]))
    writer.finish()
    out.seek(0)
    assert [(d, x.tolist()) for d, x in id_files.read_ids(out)] == [(3, [0]), (None, ids[1:].tolist())]
    for wrong in (-1, 2**32):
        with pytest.raises(ValueError):
            id_files.IdFileWriter(io.BytesIO()).add([1], np.array([wrong]), np.array([1]))
    for cut in (3, 20, len(out.getvalue()) - 1):
        with pytest.raises((id_files.Corrupt, struct.error)):
            list(id_files.read_ids(io.BytesIO(out.getvalue()[:cut])))


def test_id_files(docs, rows, empty):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    expected, at = [], 0
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = id_files.document_digests(id_files.write_ids(docs, path, end=2)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    assert id_files.document_digests(id_files.write_ids(empty, path, end=2)).count() == 0


def test_id_files_with_added_tokens(spark):
    path, token = P.path("byte_bpe_50k.json"), "<|endoftext|>"
    library = Tokenizer.from_file(path)
    texts = ["plain text", f"one{token}two", None, token, f"{token}{token} é  {token}\n", "", "ends in <|endof", "text|> begins", f" {token} ", "x" * 3000 + token, "last"]
    expected, at = [], 0
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = id_files.document_digests(id_files.write_ids(data, path, end=2)).collect()
    assert sorted(map(tuple, got)) == expected
    coder = id_files.LibraryIds(path)
    raw = [(t or "").encode() for t in texts]
    ids, bounds = coder.encode_raw(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_language(spark, empty):
    r = np.random.default_rng(2)
    syllables = {"xx": ["the", "ing", "and", "wh", "er"], "yy": ["é", "que", "oi", "le", "aux"], "zz": ["sch", "ung", "ein", "ü", "ß"]}
    rows = []
    for i in range(240):
        lang = list(syllables)[i % 3]
        rows.append((i, " ".join("".join(r.choice(syllables[lang], 3)) for _ in range(r.integers(5, 60))), lang))
    data = spark.createDataFrame([*rows, (500, None, "xx"), (501, "123 !", "yy"), (502, "Q", None), (503, rows[0][1] + " " + rows[1][1], None)], "doc_id long, text string, lang string")
    model = langid.train(data, ~langid.held_out())
    got = {x.doc_id: x for x in langid.predict(data, model).withColumn("held", langid.held_out()).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert all(got[i].held == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert (got[500].lang_pred, got[501].lang_pred) == ("und", "und") and got[502].lang_pred in syllables
    assert all(0 <= x.score <= 1 for x in got.values()) and got[503].score < 0.95
    assert langid.predict(empty, model).count() == 0
    none = langid.train(empty, ~langid.held_out())
    assert {x.lang_pred for x in langid.predict(data, none).collect()} == {"und"}


def test_language_of_six_in_one_text(spark):
    r = np.random.default_rng(8)
    letters = {f"l{k}": list("abcdefghijklmnopqrstuvwx"[4 * k : 4 * k + 4]) for k in range(6)}
    text = {lang: lambda n, own=own: " ".join("".join(r.choice(own, 5)) for _ in range(n)) for lang, own in letters.items()}
    rows = [(i, text[f"l{i % 6}"](40), f"l{i % 6}") for i in range(240)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ~langid.held_out())
    mixed = [(7, " ".join(text[lang](150 + 10 * (lang == "l5")) for lang in letters))]
    got = langid.predict(spark.createDataFrame(mixed, "doc_id long, text string"), model).first()
    assert got.lang_pred == "l5" and 1 / 6 < got.score < 0.2


def test_secrets(spark, docs, empty):
    texts = [None, "", "token=token:abcdefg", "secret: token=abcdefgh", "é" * 9 + "AKIA" + "A" * 16 + "AKIA" + "B" * 30, "a" * 24 + "g" + "f" * 23, "apikey=12345\u212a password\": \"abcdef.\"", "tokentoken==abcdef passwd=  \"''", "client_id=abcd1234 key aB3" + "x" * 40, "see https://x.y/z and secret=abcdef1 ok", "see https://x.y/z" + " é" * 300 + " secret=abcdef1", "https://x.y/z"]
    data = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts + texts[3:4])], "doc_id long, text string, row long")
    got = {r.doc_id: r for r in secrets.secret_spans(data).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, t in enumerate(texts):
        t = (t or "").replace("\u212a", "?")
        spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [s.name for s in got[i].base] == [s[2] for s in sorted(spans)], t
    weak = {i: [s.name for s in r.spans if s.name.split(":")[0] in ("loose_id", "loose_key", "endpoint")] for i, r in got.items()}
    assert weak[8] == ["loose_id:0:18", "loose_key:23:66"] and weak[9] == ["endpoint:4:17"] and not weak[10] and not weak[11]
    assert secrets.secret_spans(empty).count() == 0
    clean = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(spark.createDataFrame([(1, "x secret=abcdef1 y", 0), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")).collect()}
    assert clean == {1: ("x [SECRET] y", 12), 2: ("clean", 5), 3: (None, None)}


def weak_names(spark, texts):
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [s.name for s in r.spans if s.name.split(":")[0] in ("loose_id", "loose_key", "endpoint")] for r in secrets.secret_spans(data).collect()}
    return [found[i] for i in range(len(texts))]


def test_endpoint_beside_an_unlabelled_key(spark):
    pair = "connect https://db.example.com/x with wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLE12345Q"
    far = " é" * 300
    alone, distant, apart = weak_names(spark, [pair, pair + far + " AKIA", pair.replace(" with ", far)])
    assert alone == distant == ["endpoint:8:32"] and apart == []


def test_unlabelled_keys_after_a_sign_and_of_any_length(spark):
    key, long, huge = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLE12345", "aB3x" * 21 + "Qz==", "aB3x" * 50_000
    texts = [f"AKIA{'A' * 16} aws_secret_access_key={key}", f"AccountName=shop1;AccountKey={long}", f"AccountName=shop1 {long}", f"AccountName=shop1 {huge}", f"AccountName=shop1 {huge}_", f"AccountName=shop1 {'x' * 200_000}"]
    name = "loose_id:0:17"
    assert weak_names(spark, texts) == [["loose_key:43:83"], [name, "loose_key:29:117"], [name, "loose_key:18:106"], [name, "loose_key:18:200018"], [], []]
    data = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts[:3])], "doc_id long, text string, n_chars long")
    clean = {r.doc_id: r.text for r in secrets.redact(data).collect()}
    assert clean == {0: "[SECRET] aws_secret_access_key=[SECRET]", 1: "[SECRET];AccountKey=[SECRET]", 2: "[SECRET] [SECRET]"}


def test_url_filters(spark):
    urls = [None, "", "http://", "x://COM", "http://com/", "a://Example.COM/en/x?y#z", "a://www.example.com/en/", "a://awww.example.com/en", "net/es/", "q://x.net/es/a", "q://net/fr", "http://example.com./en/", "a://b.example.com/en/deep/x", "a://é.com/ü"]
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("example.com", "/en/deep/", "allow"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), (None, "/", "block"), ("", "/", "block")]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(None, "http://com/", "clash")], "page_id long, url string, rule string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: r for r in url_filters.judge(pages, table).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fits = [(len(h + p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else (0, None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best[1], best[2]), u
    assert got[None].rule == "com/"
    assert {r.rule for r in url_filters.judge(pages, table.limit(0), default="block").collect()} == {None}
    assert url_filters.judge(pages.limit(0), table).count() == 0


def test_warc(spark):
    rows = [(5, "u", "same"), (3, "v", "same"), (9, "w", None), (8, "x", ""), (1, None, "é" * 5000), (None, "y", "same"), (-4, "a\r\nb", "own"), (3, "v", "same")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    manifest = warc.write_archives(pages, chunk=700)
    chunks = warc.read_archives(manifest, chunk=512).collect()
    low = {"same": 3, "": 8, "é" * 5000: 1, "own": -4}
    expected = collections.Counter()
    for i, _, html in rows:
        raw, first = (html or "").encode(), low[html or ""]
        again = i is not None and i > first
        expected[(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None)] += 1
    assert collections.Counter((r.page_id, r.n_bytes, r.digest, r.record_type, r.refers_to) for r in chunks if r["last"]) == expected
    big = sorted((r for r in chunks if r.page_id == 1), key=lambda r: r.chunk_no)
    assert b"".join(bytes(r.data) for r in big) == ("é" * 5000).encode() and max(len(r.data) for r in big) <= 512
    assert {r.record_type for r in warc.last_chunks(warc.read_archives(warc.write_archives(pages, min_bytes=5))).where("payload_bytes < 5").collect()} == {"response"}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_topk(spark):
    r = np.random.default_rng(3)
    vectors = [(i, r.normal(0, 1, 6).astype(np.float32).tolist(), 0) for i in range(1500)]
    vectors += [(2000 + i, vectors[7][1], 0) for i in range(15)] + [(3000, None, 0), (3100, [1.0, None], 0), (3200, [float("nan")] * 6, 0), (None, [1.0] * 6, 0), (3300, [0.5, 0.25], 0)]
    data = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, rank int").repartition(3)
    got = collections.defaultdict(list)
    for x in topk.top_k(data, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    good = {i: np.pad(np.floor(np.array(v, np.float64) * 1024).astype(np.int64), (0, 6 - len(v))) for i, v, _ in vectors if i is not None and i not in (3000, 3100, 3200)}
    for q in (i for i in good if i % 100 == 0):
        scores = sorted((-int(v @ good[q]), i) for i, v in good.items() if i != q)[:10]
        assert got.pop(q) == [(i, -s) for s, i in scores]
    assert not got
    assert topk.top_k(data.limit(0), F.col("vec_id") % 100 == 0).count() == 0

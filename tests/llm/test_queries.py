"""Every registered training-data query and every pipeline stage over whole
tables, held against plain Python that knows the contract only."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

import corpus_pipeline
from pyspark.sql import functions as F
from tablelens.llm import quality, queries, secrets, toxicity

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def read(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def docs():
    return {d["doc_id"]: d["text"] or "" for d in read("documents")}


@pytest.fixture(scope="module")
def models(spark):
    return queries.toxicity_model(spark, SF), queries.quality_model(spark, SF)


def rows_of(spark, query):
    return query(spark, SF).collect()


def check_packing(rows, texts, capacity=4096):
    """Pieces against ``texts`` (id -> text): every id once, crc, gapless places."""
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {d: [*tok.encode(t, add_special_tokens=False).ids, 2] for d, t in texts.items()}
    pieces, places = {}, {}
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start:r.start + r.length], "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for of, whole in [(pieces, {d: len(i) for d, i in ids.items()}), (places, None)]:
        for key, parts in of.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at and length > 0
                at += length
            assert at == whole[key] if whole else at <= capacity
    total = sum(map(len, ids.values()))
    assert len(places) <= -(-total // capacity) + 1  # next to no padding


def word_lists(texts, lower=True):
    table = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}) if lower else {}
    return {d: WORD.findall(t.translate(table)) for d, t in texts.items()}


def simhash(words, n=4):
    grams = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] if len(words) > n else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def near_components(texts):
    """Fingerprint and smallest reachable id, by all pairs."""
    fps = {d: simhash(w) for d, w in word_lists(texts).items()}
    root = {d: d for d in fps}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    order = sorted(fps)
    values = np.array([fps[d] for d in order], np.uint64)
    for i, d in enumerate(order):
        for j in np.flatnonzero(np.bitwise_count(values[i:] ^ values[i]) <= 4)[1:]:
            a, b = sorted((find(d), find(order[i + j])))
            root[b] = a
    return {d: (fps[d], find(d)) for d in fps}


def base_figures(text):
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def joined(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_op1(spark, docs):
    check_packing(rows_of(spark, queries.op1_packing), docs)


def test_op2(spark, docs):
    import base64
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = rows_of(spark, queries.op2_bpe)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ids = own.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_op3(spark, docs):
    rows = rows_of(spark, queries.op3_quality)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_figures(docs[r.doc_id])
        assert r.kept == (not r.base_failed and r.probability >= 0.5)
    labels = {x["doc_id"]: x["quality"] for x in read("labels")}
    judged = [(r.kept, labels[r.doc_id]) for r in rows if r.doc_id in labels and not r.base_failed]
    assert sum(k == bool(y) for k, y in judged) >= 0.9 * len(judged)


def test_op4(spark):
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    got = {r.page_id: r for r in rows_of(spark, queries.op4_urls)}
    pages = read("pages")
    assert len(got) == len(pages)
    for p in pages:
        rest = (p["url"] or "").partition("://")[2]
        place = re.match(r"[^?#]*", rest)[0]
        host = re.match(r"[^/]*", place)[0]
        path, host = place[len(host):], host.lower() if host.isascii() else host
        fits = [(len(x), x, v) for x, v in rules if (("." + host).endswith("." + x.partition("/")[0])) and path.startswith("/" + x.partition("/")[2])]
        r = got[p["page_id"]]
        best = max(fits, default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == (best[2] if best else "block" if r.blocked_alias else "allow")


def test_op5(spark, docs):
    long_hash = lambda h, seed: xxhash.xxh64(struct.pack("<Q", h), seed=seed).intdigest()

    def fingerprint(text):
        words = word_lists({0: text})[0]
        one = [(xxhash.xxh64(w.encode(), seed=42).intdigest(), min(len(w), 12)) for w in words]
        terms = one if len(one) < 2 else [(long_hash(b[0], long_hash(a[0], 42)), a[1] + b[1]) for a, b in zip(one, one[1:])]
        total, out = sum(w for _, w in terms), 0
        again = xxhash.xxh64(struct.pack("<i", 1), seed=42).intdigest()
        for i in range(2):
            hashes = [(h if i == 0 else long_hash(h, again), w) for h, w in terms]
            out = out << 64 | sum(1 << k for k in range(64) if 2 * sum(w for h, w in hashes if h >> k & 1) > total)
        return out
    order = sorted(docs, reverse=True)
    following = dict(zip(order, order[1:] + order[:1]))
    like = lambda a, b: 1 - (a ^ b).bit_count() / 128
    fps = {d: fingerprint(t) for d, t in docs.items()}
    rows = rows_of(spark, queries.op5_fingerprints)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        text, other = docs[r.doc_id], docs[following[r.doc_id]]
        k = len(text) // 3
        edited = text[:len(text) - k] + other[:k]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert int(r.fingerprint, 16) == fps[r.doc_id] and int(r.edited_fingerprint, 16) == fingerprint(edited)
        assert r.near_edited == pytest.approx(like(fps[r.doc_id], fingerprint(edited)))
        assert r.near_next == pytest.approx(like(fps[r.doc_id], fps[following[r.doc_id]]))
        near = [d for d, f in fps.items() if (f ^ fps[r.doc_id]).bit_count() <= 3] if r.doc_id % 20 == 0 else []
        assert (r.near_rows, r.near_id) == ((len(near), min(near)) if near else (None, None))


def test_op6(spark, docs):
    want = near_components(docs)
    rows = rows_of(spark, queries.op6_near_dedup)
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in rows} == want and len(rows) == len(want)
    assert all(len(r.fingerprint) == 16 for r in rows)


def test_op7(spark, docs):
    rows = rows_of(spark, queries.op7_toxicity)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    labels = {x["doc_id"]: x["toxic"] for x in read("labels")}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in judged) >= 0.9 * len(judged)


def test_op8(spark, docs):
    rows = rows_of(spark, queries.op8_secrets)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        base = plain_spans(docs[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert set(filter(None, joined(base).split(","))) <= set(r.spans.split(","))


def test_op9(spark):
    pages = {p["page_id"]: (p["html"] or "").encode() for p in read("pages")}
    rows = rows_of(spark, queries.op9_warc)
    assert sorted(r.page_id for r in rows) == sorted(pages)
    last = {}
    for p in sorted(pages):
        last[pages[p]] = p
    for r in rows:
        data = pages[r.page_id]
        refers = last[data] if len(data) >= 1000 and last[data] != r.page_id else None
        assert (r.payload_bytes, r.payload_digest, r.refers_to) == (len(data), hashlib.sha1(data).hexdigest(), refers)
        assert r.record_type == ("response" if refers is None else "revisit")


def test_op10(spark, docs):
    rows = rows_of(spark, queries.op10_sharding)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    slots = {}
    for r in rows:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots.setdefault(r.shard, []).append(r.slot)
    counts = [len(slots.get(s, [])) for s in range(8)]
    assert set(slots) <= set(range(8)) and max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_pipeline(spark, docs, models):
    """All five stages against Python; the models are those the stages train."""
    tox, good = models
    automaton = tox.automaton()

    def toxic(text):
        a, b = toxicity._features(*toxicity.measure(toxicity.fold(text), automaton))
        return 1 / (1 + np.exp(-(tox.curve[0] + tox.curve[1] * a + tox.curve[2] * b)))

    kept = {d: t for d, t in docs.items() if toxic(t) < 0.5}
    kept = {d: t for d, t in kept.items() if not base_figures(t)[5] and good.probability(t, quality.words_of(t)) >= 0.5}
    kept = {d: kept[d] for d, (_, low) in near_components(kept).items() if low == d}
    assert 0 < len(kept) < len(docs)
    formats = secrets.learn(secrets.scan(spark.createDataFrame([(d, t) for d, t in kept.items()], "doc_id long, text string")))
    clean = {}
    for d, t in kept.items():
        base = secrets.base_spans(t)
        spans = sorted([(a, b) for a, _, b, _ in base] + [(a, a + len(x)) for a, x in secrets.candidates(t, base) if formats.secret(x)])
        out, at = "", 0
        for a, b in spans:
            out += (t[at:a] + "[SECRET]") if a >= at else ""
            at = max(at, b)
        clean[d] = out + t[at:]
    check_packing(corpus_pipeline.run(spark, SF).collect(), clean)


def test_stages_with_odd_documents(spark, models, monkeypatch):
    """Nulls, empty and repeated rows, long texts and columns that the stages
    also use inside; empty tables."""
    monkeypatch.setattr(queries, "toxicity_model", lambda *a: models[0])
    monkeypatch.setattr(queries, "quality_model", lambda *a: models[1])
    prose = [d["text"] for d in read("documents")][:6]
    rows = [(i, t) for i, t in enumerate([None, "", " \n", *prose, prose[0], " ".join(prose) * 5])] + [(None, prose[1]), (4, prose[1])]
    names = ["lang", "source", "toxicity", "quality", "secrets", "found", "hit", "base", "uid", "fp", "w", "component_id", "block"]
    odd = spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * len(names)) for r in rows],
                                "doc_id long, text string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for frame in (odd, odd.limit(0)):
        whole = frame.count()
        for name, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, frame, SF)
            assert out.schema.names == frame.schema.names, name
            got = out.collect()
            assert len(got) <= whole and all(r[n] == "x" for r in got for n in names), name
        packed = corpus_pipeline.STAGES[-1][1](spark, frame, SF).collect()
        assert sum(r.start == 0 for r in packed) == whole
    near = corpus_pipeline.near_dedup_stage(spark, odd, SF).collect()
    assert sorted(Counter(r.text for r in near).values())[-1] == 1 and None in {r.text for r in near}
    hidden = corpus_pipeline.secrets_stage(spark, odd.withColumn("text", F.concat(F.lit("password=abcdefgh "), "text")), SF).collect()
    assert all(r.text is None or (r.text.startswith("[SECRET] ") and r.n_chars == len(r.text)) for r in hidden)

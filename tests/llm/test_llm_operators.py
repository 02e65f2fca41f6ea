"""Each operator against a brute-force version, and its defined cases: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linewise.llm import decontamination, exact_dedup, language_id, mixing, near_dedup, pii, sharding, substring_dedup, token_files, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, node long, id string, text_sha256 string"
SF = "/root/testdata/sf0.001"


def rng_texts(seed, n, vocabulary=60, words=(0, 90)):
    r = random.Random(seed)
    return [" ".join(f"w{r.randrange(vocabulary)}" for _ in range(r.randint(*words))) for _ in range(n)]


def frame(spark, texts, sources=None, langs=None, ids=None):
    """Documents with columns whose names clash with those that operators add."""
    rows = [((ids[i] if ids else i), t, langs[i] if langs else "en", sources[i] if sources else "s", len(t or ""), "x", "y", 7, "z", "q") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " ", "\t\n", "a", "A", "é É", "Ünï CODE", "x" * 50_000, "w " * 5_000, "\U0001f600 emoji", "1234", "nul\x00byte", "line\r\nline"]


# 1 ----------------------------------------------------------------------------------------------------------------------


def brute_words(text):
    return re.findall(r"\w+", text.lower())


def test_word_hashes_are_one_to_one():
    texts = rng_texts(6, 50) + [t or "" for t in ODD] + ["ǅ \U0001f600 \U00010400\U00010401 x\U00010400", "İ_ı ßẞ", ""]
    hashes, ends = decontamination.word_hashes(texts)
    lists = [brute_words(t) for t in texts]
    words = [w for own in lists for w in own]
    assert ends.tolist() == np.cumsum([len(x) for x in lists]).tolist() and len(hashes) == len(words)
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))


def brute_leaks(texts, items):
    found = {}
    for d, text in enumerate(texts):
        words = brute_words(text or "")
        for i, item in enumerate(items):
            own = brute_words(item or "")
            n = len(own)
            if not n or len(words) < n:
                continue
            k = min(5, n)
            grams = lambda w: Counter(tuple(w[a : a + k]) for a in range(len(w) - k + 1))
            target, best = grams(own), 0
            for a in range(len(words) - n + 1):
                g = grams(words[a : a + n])
                common = sum((g & target).values())
                best = max(best, common / (sum(g.values()) + sum(target.values()) - common))
            if best >= 0.8:
                found[d, i] = round(best, 9)
    return found


def test_decontamination_is_brute_force(spark):
    r = random.Random(5)
    items = rng_texts(1, 25, 400, (1, 60)) + [None, "", "one two"]
    texts = rng_texts(2, 80, 400, (0, 120)) + ODD + ["zero One, TWO three"]
    for i in range(0, 60, 2):  # whole items, and items with some words changed, within other text
        own = (items[i % 25]).split()
        for _ in range(i % 4):
            own[r.choice([0, -1, r.randrange(len(own))])] = "changed"
        texts[i] = f"{texts[i]} {' '.join(own)}! {texts[i + 1]}"
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = frame(spark, texts)
    got = {(x.doc_id, x.item_id): round(x.similarity, 9) for x in decontamination.find_leaks(docs, bench).collect()}
    want = brute_leaks(texts, items)
    assert got == want and len(want) > 12 and min(want.values()) < 1
    blocks = {(x.doc_id, x.item_id) for x in decontamination.find_leaks(docs, bench, items_a_block=7).collect()}
    assert blocks == set(want)
    left = decontamination.drop_leaks(docs, bench)
    assert left.columns == docs.columns and {x.doc_id for x in left.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontamination.find_leaks(docs, bench.limit(0)).count() == 0 and decontamination.find_leaks(docs.limit(0), bench).count() == 0


def test_multi_index_blocks_miss_nothing_within_the_radius():
    index = decontamination.ItemIndex([(i, t) for i, t in enumerate(rng_texts(3, 60, 500, (30, 30)))])
    prints = np.random.default_rng(0).integers(0, 2**64, (300, 4), np.uint64)
    for i in range(200):  # flip up to the radius
        prints[i] = index.prints[i % 60]
        for bit in np.random.default_rng(i).choice(256, i % 72, replace=False):
            prints[i, bit // 64] ^= np.uint64(1 << int(bit % 64))
    got = set(zip(*(x.tolist() for x in index.candidates(30, prints))))
    want = {(a, b) for a in range(300) for b in range(60) if np.bitwise_count(prints[a] ^ index.prints[b]).sum() <= index.radius}
    assert got == want and len(want) >= 200


def test_unlike_windows_meet_in_few_blocks():
    prints = np.random.default_rng(1).integers(0, 2**64, (2000, 4), np.uint64)
    met = np.zeros((1000, 1000), bool)
    for k in range(4):
        met |= np.bitwise_count(prints[:1000, k, None] ^ prints[None, 1000:, k]) <= decontamination.RADIUS // 4
    assert met.mean() < 0.002


def test_stretches_and_long_texts_hide_nothing(monkeypatch):
    items = rng_texts(1, 12, 400, (3, 40))
    texts = [" ".join(x) for x in zip(rng_texts(2, 12, 400, (60, 120)), items, rng_texts(3, 12, 400, (60, 120)))]
    index = decontamination.ItemIndex(list(enumerate(items)))
    want = list(index.in_texts(texts))
    monkeypatch.setattr(decontamination, "WINDOWS", 7)
    monkeypatch.setattr(decontamination, "PAIRS", 21)
    monkeypatch.setattr(decontamination, "SLICE", 50)
    assert list(decontamination.ItemIndex(list(enumerate(items))).in_texts(texts)) == want and len(want) == 12
    assert ["".join(decontamination.whole_words(t, 10)) for t in texts] == texts


def test_windows_at_the_threshold_lie_within_the_radius():
    r, worst = random.Random(1), 0
    shingles = lambda words: decontamination.ItemIndex.shingles(decontamination.word_hashes([" ".join(words)])[0])
    for n in [5, 8, 13, 14, 20, 30, 45, 60] * 60:
        words = [f"t{r.randrange(10**6)}" for _ in range(n)]
        other = list(words)
        for _ in range(3):
            trial = list(other)
            trial[r.randrange(n)] = "other"
            a, b = shingles(words), shingles(trial)
            if decontamination.weighted_similarity(decontamination.counted(a), decontamination.counted(b)) < 0.8:
                break
            other = trial
        a, b = (decontamination.bit_rows(shingles(x)).sum(axis=0, keepdims=True) for x in (words, other))
        worst = max(worst, int(np.bitwise_count(decontamination.fingerprints(a, n - 4)[0] ^ decontamination.fingerprints(b, n - 4)[0]).sum(dtype=np.int64)))
    assert worst <= decontamination.RADIUS


# 2 ----------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_dedup(spark, digest_all):
    texts = ODD + ["Same Text", "same text", "SAME TEXT", "same texT ", "É", "é"] + rng_texts(4, 40, 3, (0, 3)) + ["p" * 100 + "a", "p" * 100 + "b", "p" * 100 + "B"]
    docs = frame(spark, texts + ["null id", None, "same text"], ids=[*range(len(texts)), None, None, 17])
    rows = [(i, t) for i, t in zip([*range(len(texts)), None, None, 17], texts + ["null id", None, "same text"])]
    normal = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    want = Counter()
    for i, t in rows:
        own = groups[normal(t)]
        keep = max((x for x in own if x is not None), default=None)
        want[i, keep, len(own), i == keep, hashlib.sha256(normal(t).encode()).hexdigest()] += 1
    got = exact_dedup.exact_dedup(docs, digest_all=digest_all)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    width = 5 if digest_all else 4
    assert Counter(tuple(x)[:width] for x in got.collect()) == Counter(k[:width] for k in want.elements())
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    assert exact_dedup.drop_exact_copies(docs).columns == docs.columns


def test_exact_dedup_has_no_python(spark):
    plan = exact_dedup.exact_dedup(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


# 3 ----------------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    html = [None, "", "short", "short", "x" * 99, "x" * 99, "x" * 100, "x" * 100, "é" * 50, "é" * 50, "a\r\n\r\nb" * 40, "a\r\n\r\nb" * 40, "z" * 300_000] + [f"<p>{t}</p>" for t in rng_texts(9, 60)]
    rows = [(i, None if i % 7 == 0 else f"http://a.example/{i}\r\nx: y", h, "clash") for i, h in enumerate(html)] + [(None, None, "x" * 100, "c"), (None, None, "only once " * 20, "c"), (6, "u", "x" * 100, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha string")
    first = {}
    for i, _, h, _ in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = Counter()
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        again = h in first and first[h] != i
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None] += 1
    back = warc.warc_round_trip(spark, pages)
    assert Counter((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in back.collect()) == want
    assert {x.page_id: bytes(x.payload).decode() for x in back.collect() if x.record_type == "response" and x.page_id is not None} == {i: h or "" for i, _, h, _ in rows if i is not None and not (h in first and first[h] != i)}
    assert warc.warc_round_trip(spark, pages.limit(0)).count() == 0


def test_warc_archive_has_a_dictionary_and_frames_of_its_own(tmp_path):
    import zstandard

    records = [warc.record_bytes(i, None, f"<html><body>{t}</body></html>".encode() * 20, "0" * 64, None, False, "1970-01-01T00:00:00Z") for i, t in enumerate(rng_texts(1, 80))]
    path = tmp_path / "a.warc.zst"
    with open(path, "wb") as out:
        writer = warc.ArchiveWriter(out, 16_384, 100_000, 3)
        for r in records:
            writer.add(r)
        writer.close()
    raw = path.read_bytes()
    assert int.from_bytes(raw[:4], "little") == warc.SKIPPABLE_MAGIC
    n = int.from_bytes(raw[4:8], "little")
    own = zstandard.ZstdCompressionDict(raw[8 : 8 + n])
    assert own.dict_id() and zstandard.ZstdDecompressor(dict_data=own).decompress(raw[8 + n :], read_across_frames=False) == records[0]
    for chunk in (1, 7, 1 << 20):
        assert list(warc.read_archive(open(path, "rb"), chunk)) == records
    (tmp_path / "cut").write_bytes(raw[:-5])
    with pytest.raises(ValueError):
        list(warc.read_archive(open(tmp_path / "cut", "rb")))


# 4 ----------------------------------------------------------------------------------------------------------------------


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def brute_similarity(a, b):
    a, b = (tuple(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else ((tuple(w),) if w else ()) for w in (a, b))
    matched = lcs(a, b)
    total = len(a) + len(b) - matched
    return matched / total if total else 1.0


def test_banded_alignment_is_the_longest_common_subsequence():
    r = np.random.default_rng(0)
    for trial in range(1500):
        a = r.integers(0, r.integers(2, 40), r.integers(0, 40)).astype(np.uint64)
        b = a.copy() if trial % 2 else r.integers(0, 20, r.integers(0, 40)).astype(np.uint64)
        for _ in range(trial % 6):
            if len(b):
                at = r.integers(0, len(b))
                b = np.delete(b, at) if r.random() < 0.5 else np.insert(b, at, r.integers(0, 50))
        want = lcs(a.tolist(), b.tolist())
        for least in {0, want - 1, want, want + 1, want + 4}:
            got = near_dedup.aligned(a, b, least)
            assert got == want if want >= least else got < max(least, 1)


def brute_classes(texts, threshold=0.8):
    words = [near_dedup.words_of(t or "") for t in texts]
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if top(i) != top(j) and min(len(words[i]), len(words[j])) >= 0.7 * max(len(words[i]), len(words[j])) and brute_similarity(words[i], words[j]) >= threshold:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]


def mutated(r, words, n):
    words = list(words)
    for _ in range(n):
        at = r.randrange(len(words))
        words[at : at + 1] = r.choice([[], ["new", "words"], [f"v{r.randrange(99)}"]])
    return words


def test_near_duplicates_are_brute_force(spark):
    r = random.Random(3)
    texts = [t for t in ODD if len(t or "") < 5000]
    for _ in range(12):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randint(12, 160))]
        texts.append(" ".join(base))
        texts += [" ".join(mutated(r, base, n)) for n in (1, 1, 2, 4, 12)]
        half = len(base) // 2
        texts.append(" ".join(base[half:] + base[:half]))  # the same shingles in another order
    shared = [f"p{i}" for i in range(60)]
    texts += [" ".join([f"q{r.randrange(9999)}" for _ in range(60)] + shared) for _ in range(40)]  # a passage that many share
    base = [f"c{r.randrange(9999)}" for _ in range(90)]
    texts += [" ".join(mutated(r, base, 1)) for _ in range(40)] + [texts[20].upper(), texts[20]]
    want = brute_classes(texts)
    got = near_dedup.near_duplicates(frame(spark, texts)).collect()
    assert {x.doc_id: x.class_id for x in got} == dict(enumerate(want))
    sizes = Counter(want)
    assert all(x.class_size == sizes[x.class_id] and x.kept == (x.class_id == x.doc_id) for x in got)
    left = near_dedup.drop_near_duplicates(frame(spark, texts))
    assert sorted(x.doc_id for x in left.collect()) == sorted(set(want)) and left.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert near_dedup.near_duplicates(frame(spark, texts[:1]).limit(0)).count() == 0


def shared_passage(r, hub=14, own=12, n=40):
    """Texts that share 104 words and have own tails: two with tails of `own` words are near copies, none is one of a text with `hub` words of its own."""
    passage = [f"s{i}" for i in range(104)]
    tail = lambda k: [f"o{r.randrange(10**9)}" for _ in range(k)]
    return [" ".join(passage + tail(own)) for _ in range(n)] + [" ".join(passage + tail(hub)) for _ in range(n)]


@pytest.mark.parametrize(("hub", "own"), [(14, 12), (26, 12), (25, 25), (40, 13)])
def test_every_pair_of_a_large_bucket_is_compared(spark, monkeypatch, hub, own):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "AT_ONCE", 2)
    # no hubs at all: what blocks compare must be enough, whichever hub is drawn
    monkeypatch.setattr(near_dedup, "stars", lambda members: members.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    texts = shared_passage(random.Random(hub), hub, own) + rng_texts(2, 10)
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert got == dict(enumerate(brute_classes(texts)))


def test_a_hub_unlike_all_hides_no_near_copies(spark, monkeypatch):
    texts = shared_passage(random.Random(5), hub=14)
    far = [near_dedup.xxhash.xxh3_64_intdigest(near_dedup.WordHashes().of(near_dedup.words_of(t)).tobytes()) - (1 << 63) for t in texts[40:]]

    def worst(members):
        """Stars around the largest node with a long tail in each bucket."""
        hubs = members.filter(F.col("node").isin(far)).groupBy("key").agg(F.max("node").alias("hub"))
        return members.join(hubs, "key").filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()

    monkeypatch.setattr(near_dedup, "stars", worst)
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert got == dict(enumerate(brute_classes(texts)))
    assert set(got[i] for i in range(40)) == {0}


def test_parities_never_show_more_than_the_difference():
    r, k = random.Random(7), lambda words: near_dedup.kmers(near_dedup.WordHashes().of(words))
    for _ in range(200):
        a = [f"w{r.randrange(r.choice([3, 50, 5000]))}" for _ in range(r.randint(5, 400))]
        b = mutated(r, a, r.randint(0, 30))
        one, two = k(a), k(b) if b else k(["x"])
        blocks = [near_dedup.Block([(i, i, len(x), near_dedup.parities(x))]) for i, x in enumerate((one, two))]
        assert len(blocks[0].near(blocks[1], 0.8)[0]) or near_dedup.similarity(one, two) < 0.8


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 200)]
    got = {x.node: x.component for x in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 300: 200}


@pytest.mark.parametrize("near", [True, False])
def test_rows_without_an_id_of_their_own_lose_only_copies(spark, near):
    import corpus_pipeline

    plain = rng_texts(71, 12, 900, (20, 40))
    texts = plain + [plain[0], plain[1], plain[1], plain[2].upper(), plain[3], plain[3], plain[4]]
    ids = [None, 5, None, 5, None, 5, 5, None, 1, 2, None, 5] + [None, 5, None, 5, 9, 9, 5]
    docs = frame(spark, texts, ids=ids)
    drop = (lambda d: corpus_pipeline.drop_near_copies(spark, d, SF)) if near else exact_dedup.drop_exact_copies
    left = drop(docs)
    assert left.columns == docs.columns
    assert Counter(x.text.lower() for x in left.collect()) == Counter(plain)
    best = {}
    for i, t in zip(ids, texts):
        best.setdefault(t.lower(), []).append(i)
    keep = (lambda own: min((x for x in own if x is not None), default=None)) if near else (lambda own: max((x for x in own if x is not None), default=None))
    assert {x.text.lower(): x.doc_id for x in left.collect()} == {t: keep(own) for t, own in best.items()}


# 5 ----------------------------------------------------------------------------------------------------------------------


def brute_substrings(rows, window):
    split = re.compile(r"[^\x20\x09-\x0D]+")
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    for i in order:
        words = split.findall(rows[i][1] or "")
        for a in range(len(words) - window + 1):
            seen.setdefault(tuple(words[a : a + window]), (rows[i][0], a))
    for doc, text in rows:
        words, gone = split.findall(text or ""), set()
        for a in range(len(words) - window + 1):
            if seen[tuple(words[a : a + window])] != (doc, a):
                gone.update(range(a, a + window))
        kept = [w for j, w in enumerate(words) if j not in gone]
        out.append((doc, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("chunk", "divide"), [(300, False), (300, True), (8_000_000, True)])
def test_substring_dedup_is_brute_force(spark, monkeypatch, chunk, divide):
    if divide:
        monkeypatch.setattr(substring_dedup, "full_buckets", lambda rows, buckets, window: {b: 2 + b % 3 for b in range(0, buckets, 2)})
    r = random.Random(8)
    texts = [t for t in ODD if len(t or "") < 60_000] + rng_texts(11, 60, 2, (0, 80)) + rng_texts(12, 40, 500, (15, 90))
    passage = " ".join(f"p{i}" for i in range(33))
    texts += [f"{a} {passage}\n{b}" for a, b in zip(rng_texts(13, 30, 300), rng_texts(14, 30, 300))] + [texts[-3], texts[-3], None]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    rows = list(zip(ids, texts)) + [(None, texts[-2]), (ids[5], texts[5]), (ids[-5], texts[-5])]
    docs = frame(spark, [t for _, t in rows], ids=[i for i, _ in rows]).repartition(3)
    got = substring_dedup.digests(substring_dedup.dedup_substrings(docs, chunk_bytes=chunk))
    assert Counter(tuple(x) for x in got.collect()) == brute_substrings(rows, 20)
    assert substring_dedup.dedup_substrings(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [200_000, 0])
@pytest.mark.parametrize("chunk", [300, 8_000_000])
def test_substring_dedup_of_rows_without_an_id_of_their_own(spark, monkeypatch, chunk, sent):
    monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", sent, raising=False)
    passage = " ".join(f"p{i}" for i in range(25))
    texts = rng_texts(21, 40, 500, (15, 70)) + [f"{a} {passage} {b}" for a, b in zip(rng_texts(22, 30, 300, (5, 30)), rng_texts(23, 30, 300, (5, 30)))] + [passage] * 5 + [f"{passage} own end", f"{passage} other end"]
    ids = [None if i % 3 == 0 else 7 if i % 3 == 1 else 100 + i for i in range(len(texts))]
    docs = frame(spark, texts, ids=ids).repartition(3)
    own = {x.text: x.h for x in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    names = sorted({(i is not None, i or 0, own[t]) for i, t in zip(ids, texts)})
    rank = [names.index((i is not None, i or 0, own[t])) for i, t in zip(ids, texts)]
    want = Counter()
    for (doc, n, gone, sha), times in brute_substrings(list(zip(rank, texts)), 20).items():
        flag, i, _ = names[doc]
        want[i if flag else None, n, gone, sha] += times
    got = substring_dedup.digests(substring_dedup.dedup_substrings(docs, chunk_bytes=chunk))
    assert Counter(tuple(x) for x in got.collect()) == want


def test_buckets_of_common_words_are_found_and_divided(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LOOKED_AT", 2)
    monkeypatch.setattr(substring_dedup, "LEAST_WORDS", 50)
    texts = [f"{t} all the same words of one kind {u}" for t, u in zip(rng_texts(1, 120, 9000, (20, 20)), rng_texts(2, 120, 9000, (20, 20)))]
    rows = substring_dedup.named_rows(frame(spark, texts), "doc_id", "text")
    full = substring_dedup.full_buckets(rows, 400, 20)
    assert full and all(n > substring_dedup.FULL for n in full.values()) and len(full) < 40
    hashes = substring_dedup.WordHashes()
    for text in texts[:20]:
        own = hashes.of(text.split())
        for _, first, count in zip(*(x.tolist() for x in substring_dedup.super_kmers(own))):
            _, at, n = substring_dedup.divided(own, first, count)
            assert [w for a, k in zip(at.tolist(), n.tolist()) for w in range(a, a + k)] == list(range(first, first + count))


def test_equal_hashes_of_different_windows_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring_dedup, "gram_hashes", lambda words, n, seed=0: np.zeros(max(0, len(words) - n + 1), np.uint64))
    strings = [" ".join(w) for w in (["a"] * 22, list("bcdefghijklmnopqrstuv"), list("bcdefghijklmnopqrstuw"))]
    blob = substring_dedup._pack([1, 2, 3], [0, 0, 0], strings)
    got = sorted(zip(*(x.tolist() for x in substring_dedup.repeats_of([blob]))))
    assert got == [(1, 1, 22), (3, 0, 20)]


# 6 ----------------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, capped, budget = {}, set(), 1.5 * sum(sizes.values())
    while True:
        rest = budget - sum(2 * sizes[s] for s in capped)
        total = sum(weight[s] for s in names if s not in capped)
        target = {s: 2.0 * sizes[s] if s in capped else rest * weight[s] / total for s in names}
        over = {s for s in names if s not in capped and target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mixing(spark):
    r = random.Random(2)
    texts = rng_texts(21, 600, 50, (0, 60)) + ODD
    sources = [r.choice(["a", "a", "a", "B", "c", "ä", "zz", None, "d"]) for _ in texts]
    sources[-1] = "alone without a word"
    texts[-1] = "  "
    docs = frame(spark, texts, sources)
    rows = mixing.mix_sources(docs).collect()
    sizes = Counter()
    for t, s in zip(texts, sources):
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes)
    taken = Counter()
    for x in rows:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source]) and x.taken <= 2 * x.size and x.taken in (0, x.size, 2 * x.size)
        taken[x.source] += x.taken
    longest = max(x.size for x in rows)
    assert all(abs(taken[s] - want[s]) <= 2 * longest for s in sizes) and sum(taken.values()) <= sum(want.values())
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix_sources(docs.repartition(7)).collect()))
    out = mixing.take_mix(docs)
    assert out.columns == docs.columns and Counter(x.doc_id for x in out.collect()) == Counter({x.doc_id: x.copies for x in rows if x.copies})
    assert mixing.mix_sources(docs.limit(0)).count() == 0


@pytest.mark.parametrize("in_order", [1, 5, 100_000])
@pytest.mark.parametrize("budget", [0.0, 3.0, 40.5, 1000.0, 10**9])
def test_end_of_the_budget(spark, in_order, budget):
    r = random.Random(int(budget) + in_order)
    rows = [(i, r.randint(1, 9), r.choice([5, 5, 7, r.randrange(1 << 60)]), r.choice([0.25, 0.25, 0.25, r.random()]), 1 + r.random()) for i in range(150)]
    queue = spark.createDataFrame(rows, "id long, size long, key long, time1 double, time2 double")
    got = mixing.budget_end(queue, budget, in_order, slots=4)
    each = sorted([(t, k, i, n, nth) for i, n, k, t1, t2 in rows for nth, t in ((1, t1), (2, t2))])
    total, last = 0, None
    for t, k, _, n, _ in each:
        total += n
        if total > budget:
            break
        last = (t, k)
    taken = [(t, k) for t, k, *_ in each if t < got[0] or (t == got[0] and k <= got[1])]
    want = [(t, k) for t, k, *_ in each if last and (t, k) <= last]
    if in_order > 60:
        assert taken == want
    else:  # rows of one key stay together
        assert sum(n for t, k, _, n, _ in each if t < got[0] or (t == got[0] and k <= got[1])) <= budget and set(want) - set(taken) <= {last}


# 7 ----------------------------------------------------------------------------------------------------------------------


def jump(key, buckets):
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(1).integers(0, 2**63, 400).astype(np.uint64)
    for n in (1, 2, 40, 41):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]


def test_sharding(spark):
    texts = rng_texts(31, 400) + ODD + ["tie", "tie"]
    docs = frame(spark, texts, ids=[*range(len(texts) - 3), None, 5, 5])
    rows = sharding.sharded(spark, docs, 6).collect()
    assert Counter((x.doc_id, x.text) for x in rows) == Counter((x.doc_id, x.text) for x in docs.collect())
    slots = {}
    for x in rows:
        slots.setdefault(x.shard, []).append(x.slot)
        assert x.size == len((x.text or "").encode()) + 16 and x.grown_shard in (x.shard, 6)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(6))
    grown = {x.doc_id: x.shard for x in sharding.shuffle_into_shards(docs, 7).collect()}
    assert all(grown[x.doc_id] == x.grown_shard for x in rows)
    again = {(x.doc_id, x.text, x.shard, x.slot) for x in sharding.shuffle_into_shards(docs.repartition(5), 6).collect()}
    assert again == {(x.doc_id, x.text, x.shard, x.slot) for x in rows}
    small = {(x.doc_id, x.shard) for x in sharding.shuffle_into_shards(docs, 6, bucket_bytes=500).collect()}
    assert small == {(x.doc_id, x.shard) for x in rows}
    order = [x.doc_id for x in sorted(rows, key=lambda x: (x.shard, x.slot)) if x.doc_id is not None]
    assert order != sorted(order)
    assert sharding.shuffle_into_shards(docs.limit(0), 6).count() == 0
    assert {(x.size_of_docs, x.shard_of_docs) for x in rows} == {("x", "y")} and set(docs.columns) - {"size", "shard"} <= set(rows[0].asDict())
    again = frame(spark, texts, ids=[7] * len(texts))  # one id in all rows: one shard, and all of its buckets
    at = sharding.shuffle_into_shards(again, 3, buckets_a_shard=4).select("shard", "slot", F.spark_partition_id().alias("p")).collect()
    assert len({x.shard for x in at}) == 1 and sorted(x.slot for x in at) == list(range(len(texts))) and len({x.p for x in at}) > 1


# 8 ----------------------------------------------------------------------------------------------------------------------


def test_token_files(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    texts = rng_texts(41, 120) + ODD + ["don't STOP now x", "é ́x", "ΑΣ ΣΑΣ", "<|endoftext|> <|startoftext|>x", 'say "hi"', "İI ıi", "a\x1cb\x85c", "1 2,3.4"]
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    ids[3] = None
    docs = frame(spark, texts, ids=ids)
    got = token_files.token_files_round_trip(spark, docs, length=32, batch_rows=4).collect()
    assert len(got) == len(texts)
    want, at = {}, 0
    for i, t in sorted(zip(ids, texts), key=lambda x: (x[0] is not None, x[0] or 0)):
        own = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want[i] = (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)
    assert {x.doc_id: (x.start, x.n_tokens, x.ids_crc32) for x in got} == want
    path = got[0].file
    with pa.memory_map(path) as source:
        file = pa.ipc.open_file(source)
        before = pa.total_allocated_bytes()
        batch = file.get_batch(0)
        assert batch.column("ids").type.list_size == 32 and pa.total_allocated_bytes() - before < 1000 and 0 < batch.num_rows <= 4
    assert token_files.token_files_round_trip(spark, docs.limit(0)).count() == 0


def test_pieces_have_the_tokenizers_ids_for_letters_and_marks_of_all_scripts():
    import unicodedata

    pieces = token_files.PieceIds(token_files.default_tokenizer())
    assert pieces.by_piece
    for c in range(0x80, 0x30000):
        kind = unicodedata.category(chr(c))
        if kind[0] in "LMNZ" or kind in ("Cf", "Po") or (kind == "Cc"):
            if kind == "Lo" and c > 0x3400 and c % 19:
                continue  # ideographs and syllables differ in nothing that matters here
            text = f"a{chr(c)}. {chr(c)}, x{chr(c)}!b \u00e9{chr(c)}? A{chr(c)}; W{chr(c)}:"
            pieces.forget()
            lists = token_files.pieces_of(text)
            pieces.learn(set(lists))
            assert pieces.of_pieces(lists) == pieces._bytes(pieces.tokenizer.encode(text, add_special_tokens=False)), ascii(text)


def test_pieces_of_random_texts_have_the_tokenizers_ids():
    r = random.Random(9)
    pieces = token_files.PieceIds(token_files.default_tokenizer(), limit=40)
    signs = list("abzAZ019 .,;:!?'<|>-_\t\n") + ["\u0130", "\u0307", "\u09dc", "\u0958", "\ufb2a", "\u00df", "\u1e9e", "\u03a3", "\u00e9", "e\u0301", "\u4e2d", "\U0001f600", "\x1c", "\x85", "\u2028", "'s", "n't", "<|endoftext|>"]
    for _ in range(4000):
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 30)))
        lists = token_files.pieces_of(text)
        pieces.learn(set(lists))
        assert pieces.of_pieces(lists) == pieces._bytes(pieces.tokenizer.encode(text, add_special_tokens=False)), ascii(text)


# 9 ----------------------------------------------------------------------------------------------------------------------


def brute_pii(text):
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]

    def checks(s):
        digits = [int(c) for c in s if c.isdigit()]
        total = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
        return 16 <= len(digits) <= 19 and total % 10 == 0

    card = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if checks(m[0])]
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return {"email": email, "ip": ip, "card": card, "phone": phone}


def test_base_spans_are_the_patterns():
    r = random.Random(0)
    for _ in range(6000):
        text = "".join(r.choice(["a", "Z", "@", ".", "-", " ", "1", "25", "255", "+", "(", "0", "4111111111111111", "a@b.c", "1.2.3.4", "٣", "é", "_", "%"]) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(text) == brute_pii(text), text
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+1" * 100_000, "1." * 100_000, "1-" * 100_000):
        pii.base_spans(text)  # in linear time


def test_pii_terms(spark):
    r = random.Random(4)
    plain = rng_texts(51, 200, 40, (20, 40))
    secret = "ann@corp.example"
    texts = plain + [f"{t} Zoltan wrote {secret} today w{r.randrange(9)} {u}" for t, u in zip(rng_texts(52, 12, 40, (10, 20)), rng_texts(53, 12, 40, (10, 20)))]
    texts += ["copied words beside bob@corp.example here"] * 9 + ODD
    docs = frame(spark, texts)
    rows = {x.doc_id: x for x in pii.find_pii(docs, carry=("text",)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        base = brute_pii(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k])
        x = rows[i]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [len(base[k]) for k in pii.KINDS]
        assert x.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [s for s in x.spans.split(",") if s and not s.startswith("term:")] == [s for s in joined.split(",") if s]
    marked = {i: [text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in rows[i].spans.split(",") if s.startswith("term:")] for i, text in enumerate(texts) if rows[i].n_term}
    assert set(marked) == set(range(200, 212)) and all("Zoltan" in m for m in marked.values())
    assert "Zoltan" not in rows[200].clean_text and "[EMAIL]" in rows[200].clean_text and secret not in rows[200].clean_text
    assert pii.find_pii(docs.limit(0)).count() == 0


def brute_disclosure(texts, words=8, support=3):
    """(entity, term or class) -> disclosure, with plain counting over different texts."""
    from math import log

    different = sorted({t or "" for t in texts})
    wide = lambda t: {t, *(t[:k] + "*" for k in (1, 2, 3) if len(t) > k)}
    contexts, entity_docs, occurs = {}, {}, Counter()
    for text in different:
        spans = [(kind, a, b) for kind, own in brute_pii(text).items() for a, b in own]
        every = list(re.finditer(r"\w+", text))
        occurs.update({c for t in re.findall(r"\w+", text.lower()) for c in wide(t)})
        for kind, a, b in spans:
            near = [m for m in every if m.end() <= a][-words:] + [m for m in every if m.start() >= b][:words]
            near = [m[0].lower() for m in near if not m[0].isdigit()]
            entity = pii.entity_key(kind, text[a:b])
            entity_docs.setdefault(entity, set()).add(text)
            for t in near:
                for c in wide(t):
                    contexts.setdefault((entity, c), set()).add(tuple(near))
    terms = {(e, c) for (e, c), own in contexts.items() if len(own) >= support and not c.endswith("*")}
    known = terms | {(e, t[:k] + "*") for e, t in terms for k in (1, 2, 3) if len(t) > k}
    n = len(different)
    return {(e, c): 1 + log(min(1, len(contexts[e, c]) / occurs[c])) / max(1e-9, log(n / len(entity_docs[e]))) for e, c in known}


def secret_texts():
    return rng_texts(51, 200, 40, (20, 40)) + [f"{t} Zoltan wrote {'long' * 40} ann@corp.example today w{i % 9} {u}" for i, (t, u) in enumerate(zip(rng_texts(52, 12, 40, (10, 20)), rng_texts(53, 12, 40, (10, 20))))] + ["zola zone zigzag"] * 3 + [f"zolpidem {i} zolder z{i}" for i in range(60)]


@pytest.mark.parametrize("sent", [16 << 20, -1])
def test_terms_and_classes_are_brute_force(spark, monkeypatch, sent):
    send = pii.sendable
    monkeypatch.setattr(pii, "sendable", lambda rows, size, most=0: send(rows, size, sent))
    texts = secret_texts() + ODD
    scores = brute_disclosure(texts)
    want = {}
    for (e, t), d in scores.items():
        if d >= 0.75 and not t.endswith("*"):
            classes = [t[:k] + "*" for k in (3, 2, 1) if len(t) > k and scores[e, t[:k] + "*"] < 0.75]
            want[e, t] = (pytest.approx(d), classes[0] if classes else None)
    got = {(x.entity, x.term): (x.disclosure, x.instead) for x in pii.disclosing_terms(frame(spark, texts)).collect()}
    assert got == want
    by_term = {t: instead for (_, t), (_, instead) in got.items()}
    assert by_term["zoltan"] == "zol*" and "long" * 40 in by_term
    rows = {x.doc_id: x for x in pii.find_pii(frame(spark, texts)).collect()}
    assert "[zol*] [" in rows[200].clean_text and "Zoltan" not in rows[200].clean_text and "longlong" not in rows[200].clean_text


@pytest.mark.parametrize("sent", [16 << 20, -1])
def test_copies_of_a_text_keep_its_disclosing_terms(spark, monkeypatch, sent):
    send = pii.sendable
    monkeypatch.setattr(pii, "sendable", lambda rows, size, most=0: send(rows, size, sent))
    texts = secret_texts()
    own = lambda rows: {(x.entity, x.term): (pytest.approx(x.disclosure), x.instead) for x in rows}
    once = own(pii.disclosing_terms(frame(spark, texts)).collect())
    copied = own(pii.disclosing_terms(frame(spark, texts + texts[205:206] * 300 + texts[:1] * 50)).collect())
    assert copied == once and "zoltan" in {t for _, t in once}


# 10 ---------------------------------------------------------------------------------------------------------------------


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs, rows_a_language=200, landmarks=128)
    lang = {x.doc_id: x.lang for x in docs.select("doc_id", "lang").collect()}
    rows = language_id.identify(docs, model).collect()
    held = [x for x in rows if x.held_out]
    assert len(rows) == 1000 and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1 for x in rows)
    assert sum(x.lang_pred == lang[x.doc_id] for x in held) / len(held) > 0.97
    odd = language_id.identify(frame(spark, ODD), model).collect()
    assert {x.doc_id for x in odd if x.lang_pred == "und"} == {i for i, t in enumerate(ODD) if not any(c.isalpha() for c in t or "")}
    assert all(x.score == 0 for x in odd if x.lang_pred == "und")
    assert language_id.identify(docs.limit(0), model).count() == 0
    nothing = language_id.train(docs.limit(0))
    assert {x.lang_pred for x in language_id.identify(docs.limit(5), nothing).collect()} == {"und"}
    left = language_id.drop_unidentified(frame(spark, ODD), model)
    assert left.columns == frame(spark, ODD).columns


def test_training_is_the_ridge_regression_of_the_kernel(spark):
    r = random.Random(4)
    alphabets = {"x": "abcde", "y": "defgh", "z": "ghijk"}
    rows = [(lang, " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(r.randint(3, 15)))) for lang, letters in alphabets.items() for _ in range(12)]
    rows += [("x", rows[0][1])] * 30 + [("y", None), (None, "abc"), ("z", "")]  # one text in many copies, and rows that teach nothing
    docs = frame(spark, [t for _, t in rows], langs=[lang for lang, _ in rows])
    model = language_id.train(docs, landmarks=12)
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(len(rows))]
    own = sorted({(lang, t) for (lang, t), out in zip(rows, held) if lang and t and not out})
    assert model.languages == ("x", "y", "z")
    draw = {x.text: x.d for x in docs.filter("text is not null").select("text", F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(1 << 40)).alias("d")).collect()}
    marks = [t for lang in alphabets for t in sorted((t for k, t in own if k == lang), key=draw.get)[:4]]
    sets = {t: set(language_id.presence(t).tolist()) for _, t in own}
    kernel = lambda a, b: len(sets[a] & sets[b]) / np.sqrt(len(sets[a]) * len(sets[b]))
    c = np.array([[kernel(t, m) for m in marks] for _, t in own])
    k = np.array([[kernel(a, b) for b in marks] for a in marks])
    target = np.array([[float(lang == name) for name in model.languages] for lang, _ in own])
    scale = np.trace(c.T @ c) / len(marks)
    weights = np.linalg.solve(c.T @ c + 1e-3 * scale * k + 1e-8 * scale * np.eye(len(marks)), c.T @ target)
    assert np.allclose(model.scores([language_id.presence(t) for _, t in own]), c @ weights, atol=2e-3)


def test_many_languages_are_all_learned(spark):
    texts = [f"{chr(0x4E00 + 7 * k)}{chr(0x4E00 + 7 * k + 1)} {chr(0x4E00 + 7 * k + i % 3)}" for k in range(300) for i in range(3)]
    model = language_id.train(frame(spark, texts, langs=[f"l{k:03}" for k in range(300) for _ in range(3)]))
    assert len(model.languages) >= 290


def test_scores_are_the_kernel_ridge_regression():
    texts = rng_texts(1, 8, 30, (5, 20))
    sets = [set(language_id.presence(t).tolist()) for t in texts]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    weights = np.random.default_rng(0).normal(size=(3, 2))
    base = np.zeros((language_id.SLOTS, 3))
    for j in range(3):
        base[list(sets[j]), j] = 1 / np.sqrt(len(sets[j]))
    model = language_id.Model(("x", "y"), base @ weights)
    want = np.array([[kernel(a, b) for b in sets[:3]] for a in sets]) @ weights
    assert np.allclose(model.scores([language_id.presence(t) for t in texts]), want)


# pipeline ---------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in c.STAGES] == ["language", "near_dedup", "decontamination", "mixing", "tokens"]
    extra = docs.union(frame(spark, [None, "", "123 456"], ids=[900, 901, 902]).select(*docs.columns))
    texts = {x.doc_id: x for x in extra.collect()}
    kept = c.identify_language(spark, extra, SF)
    assert kept.columns == docs.columns
    names = {x.doc_id for x in kept.collect()}
    assert names == {i for i, x in texts.items() if any(ch.isalpha() for ch in x.text or "")}
    one = {x.doc_id for x in c.drop_near_copies(spark, docs, SF).collect()}
    ids = sorted(x.doc_id for x in docs.collect())
    classes = brute_classes([" ".join((texts[i].text or "").split()[:400]) for i in ids]) if max(len((texts[i].text or "").split()) for i in ids) <= 400 else None
    if classes:
        assert one == {ids[k] for k in set(classes)}
    bench = [x.text for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {x.doc_id for x in c.decontaminate(spark, docs, SF).collect()}
    assert clean == set(ids) - {ids[d] for d, _ in brute_leaks([texts[i].text for i in ids], bench)}
    mixed = c.mix(spark, docs, SF)
    assert mixed.columns == docs.columns and {x.doc_id for x in mixed.collect()} <= set(ids)
    out = c.run(spark, SF)
    rows = sorted(out.collect(), key=lambda x: x.start)
    assert rows and [x.start for x in rows] == np.cumsum([0] + [x.n_tokens for x in rows])[:-1].tolist()
    assert [x.doc_id for x in rows] == sorted(x.doc_id for x in rows)
    assert os.path.exists(rows[0].file)

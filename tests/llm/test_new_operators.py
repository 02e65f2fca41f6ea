"""Search, alignment of tokenizers and the Jaccard join against brute force, with their defined cases."""

import glob
import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from linewise.llm import jaccard_join, lexical_search, queries, token_alignment
from tests.llm.test_llm_operators import ODD, SF, frame, rng_texts


# 11 ---------------------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, best=20):
    own = [(i, Counter(brute_terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in own if c), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in own:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in brute_terms(text) if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scores)[:best])]
    return sorted(out, key=str)


@pytest.mark.parametrize("window, block_terms", [(8192, 50_000), (3, 40)])
def test_search_is_brute_force(spark, window, block_terms):
    texts = rng_texts(1, 120, 80) + ODD + rng_texts(1, 15, 80) + [None, "", "Zebra-zebra ZEBRA Été", "zebra"]
    items = rng_texts(2, 20, 90, (0, 12)) + ["w1 w1 W1 w2", "zebra Été été", None, "", "!!", "w5"]
    bench = spark.createDataFrame([*enumerate(items), (None, "w7 w8")], "item_id long, text string")
    index = lexical_search.build_index(frame(spark, texts).repartition(5), window=window)
    got = sorted((tuple(x) for x in lexical_search.search(index, bench, block_terms=block_terms).collect()), key=str)
    assert got == brute_search(list(enumerate(texts)), [*enumerate(items), (None, "w7 w8")]) and len(got) > 300


def test_search_with_ties_repeats_and_ids_that_are_null(spark):
    texts, ids = ["one two"] * 30 + ["one", "three", "two two"] + ["pad " * 5] * 40, [*range(28), None, None, 5, 6, None, *range(100, 140)]
    items = [(1, "one two"), (1, "one two"), (2, "three"), (2, "two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(x) for x in lexical_search.search(lexical_search.build_index(frame(spark, texts, ids=ids), window=4), bench).collect()), key=str)
    assert got == brute_search(list(zip(ids, texts)), sorted(set(items))) and sum(x[2] is None for x in got) >= 1


def test_search_of_nothing(spark):
    bench = spark.createDataFrame([(1, "one"), (2, None)], "item_id long, text string")
    assert lexical_search.search(lexical_search.build_index(frame(spark, [None]).limit(0)), bench).count() == 0
    assert lexical_search.search(lexical_search.build_index(frame(spark, [None, "", "!"])), bench).count() == 0
    assert lexical_search.search(lexical_search.build_index(frame(spark, ["one", "two"])), bench.limit(0)).count() == 0


def test_a_term_of_most_documents_scores_nothing_and_long_texts_are_whole(spark):
    texts = ["all " + "x " * 200_000 + "rare"] + ["all"] * 10
    bench = spark.createDataFrame([(1, "all"), (2, "rare")], "item_id long, text string")
    got = [tuple(x) for x in lexical_search.search(lexical_search.build_index(frame(spark, texts)), bench).collect()]
    assert sorted(got, key=str) == brute_search(list(enumerate(texts)), [(1, "all"), (2, "rare")])
    assert [x[2] for x in got if x[0] == 2] == [0]


def test_registered_search_is_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted(con.execute(lexical_search.ORACLE_SQL).fetchall())
    assert sorted(tuple(x) for x in queries.op11_lexical_search(spark, SF).collect()) == want and len(want) > 100


# 12 ---------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pair_of_tokenizers():
    return token_alignment.loaded(*token_alignment.default_tokenizers())


def brute_groups(t, text):
    """Groups of ids by the contract's words: offsets where tokens of both end cut the text."""
    if not text:
        return []
    ids_a, ids_b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
    if not t.fits(text, ids_a, ids_b):
        return []
    ends_a, ends_b = (np.cumsum([len(own[i]) for i in ids]).tolist() for own, ids in ((t.bytes_a, ids_a), (t.bytes_b, ids_b)))
    groups, before = [], 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        groups.append(tuple([i for i, e in zip(ids, ends) if before < e <= cut] for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))))
        before = cut
    return groups


def brute_alignment(t, texts):
    every = [brute_groups(t, x) for x in texts]
    links = [Counter((a, b) for own_a, own_b in groups for a in own_a for b in own_b) for groups in every]
    counts = Counter(p for own in links for p in own)
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(n, most.get(a, 0))
    out = []
    for groups, own in zip(every, links):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        best = sum(n for (a, b), n in own.items() if counts[a, b] == most[a])
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(own.values()), best, sum(n * counts[p] for p, n in own.items()), hashlib.sha256(text.encode()).hexdigest() if groups else "", text))
    return out


MARKS = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "12", "中", "\U0001f600", " ", "　", "\u0085", "\x1c", "▁", "<s>", "<|endoftext|>", "<0x41>", "!", "...", "́", "​", "\x00", "tion"]


@pytest.mark.parametrize("held", [1 << 21, 40, 0])
def test_alignment_is_brute_force(spark, pair_of_tokenizers, held):
    r = random.Random(3)
    texts = ODD + rng_texts(1, 30) + ["".join(r.choice(MARKS) for _ in range(r.randrange(15))) for _ in range(300)] + ["x" * 300, "ab " * 200, "<|endoftext|> <s> x"]
    got = {x.doc_id: x for x in token_alignment.align_tokens(frame(spark, texts), held=held).collect()}
    want = brute_alignment(pair_of_tokenizers, texts)
    assert len(got) == len(texts) and sum(1 for x in want if not x[6]) > 5
    for i, own in enumerate(want):
        x = got[i]
        assert (x.n_a, x.n_b, x.n_groups, x.n_links, x.n_best, x.count_sum, x.groups_sha256, x.groups) == own, repr(texts[i])


def test_overlaps_are_pairs_of_tokens_that_share_bytes():
    r = random.Random(4)
    for _ in range(200):
        n = r.randrange(1, 30)
        cut = lambda: np.diff([0, *sorted(r.sample(range(1, n), r.randrange(0, n))), n]) if n > 1 else np.array([1])
        a, b = cut(), cut()
        ends_a, ends_b = np.cumsum(a), np.cumsum(b)
        i, j, ends = token_alignment.overlaps_and_cuts(a, b)
        want = [(x, y) for x in range(len(a)) for y in range(len(b)) if max(ends_a[x] - a[x], ends_b[y] - b[y]) < min(ends_a[x], ends_b[y])]
        assert list(zip(i.tolist(), j.tolist())) == sorted(want)
        assert set(np.cumsum(a)[i[ends]]) == set(ends_a) & set(ends_b)


def test_alignment_of_large_groups_and_small_caches(spark, pair_of_tokenizers, monkeypatch):
    texts = rng_texts(8, 20) + ["aaaaaaaaaaab" * 40, "中文字" * 50]
    want = brute_alignment(pair_of_tokenizers, texts)
    monkeypatch.setattr(token_alignment, "DENSE", 0)
    monkeypatch.setattr(token_alignment, "KEPT", 3)
    monkeypatch.setattr(token_alignment, "AT_ONCE", 2)
    pieces = token_alignment.Pieces(pair_of_tokenizers)
    for text, own in zip(texts, want):
        number, lengths = pieces.of_texts([text])
        assert token_alignment.sums(pieces.table[number], lengths)[0, :4].tolist() == list(own[:4])
        assert ";".join(pieces.texts[i] for i in number) == own[7]


def test_alignment_keeps_few_slices_in_memory(spark):
    """Slices have megabytes each; all those of a task in one row group filled an executor that read them."""
    texts = spark.range(0, 300_000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 6), x -> concat('word', pmod(xxhash64(id, x), 3000))))").alias("text"))
    since = len(getattr(spark.sparkContext, "_linewise_written", []))
    assert token_alignment.align_tokens(texts, groups=False).count() == 300_000
    path = next(x for x in spark.sparkContext._linewise_written[since:] if "aligned-slices" in x).removeprefix("file://")
    parts = [pq.ParquetFile(x).metadata for x in glob.glob(f"{path}/part-*.parquet")]
    sizes = [m.row_group(i).total_byte_size for m in parts for i in range(m.num_row_groups)]
    assert sum(m.num_rows for m in parts) > 5 and sum(sizes) > 20_000_000 and max(sizes) <= 17_000_000


def test_pieces_kept_are_bounded_by_bytes(pair_of_tokenizers, monkeypatch):
    """Texts without blanks are pieces as long as they are, so their number alone bounds nothing."""
    monkeypatch.setattr(token_alignment, "KEPT_BYTES", 200_000, raising=False)
    r = random.Random(6)
    texts = ["".join(r.choice("aeiourstln") for _ in range(2000)) for _ in range(60)]
    want = brute_alignment(pair_of_tokenizers, texts)
    pieces, most = token_alignment.Pieces(pair_of_tokenizers), 0
    for text, own in zip(texts, want):
        number, _ = pieces.of_texts([text, "of all"])
        assert ";".join(pieces.texts[i] for i in number[:1]) == own[7]
        kept = sum(map(len, pieces.number)) + sum(map(len, pieces.texts)) + pieces.keys.nbytes + pieces.links.nbytes
        assert kept < 300_000
        most = max(most, kept)
    assert most > 200_000 and kept == pieces.bytes and {"of", "all"} <= pieces.number.keys()


def test_alignment_of_nothing_and_of_repeated_rows(spark):
    assert token_alignment.align_tokens(frame(spark, []).limit(0)).count() == 0
    rows = token_alignment.align_tokens(frame(spark, ["one two", "one two", None], ids=[None, None, 5])).collect()
    assert len(rows) == 3 and len({str(x) for x in rows}) == 2 and {x.count_sum for x in rows if x.doc_id is None} == {2 * next(x.n_links for x in rows if x.doc_id is None)}


def test_registered_alignment_over_a_whole_table(spark, pair_of_tokenizers):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((x.doc_id for x in rows), brute_alignment(pair_of_tokenizers, [x.text for x in rows])))
    got = queries.op12_token_alignment(spark, SF).collect()
    assert {x.doc_id: tuple(x)[1:] for x in got} == {k: x[:7] for k, x in want.items()} and len(got) == len(rows)


# 13 ---------------------------------------------------------------------------------------------------------------------


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute_components(ids, texts):
    """(id, size, smallest id reachable) of each row, by rows that all meet."""
    sets = [brute_set(t) for t in texts]
    of = list(range(len(texts)))

    def root(i):
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 10 * min(len(a), len(b)) >= 9 * max(len(a), len(b)) and 100 * len(a & b) >= 90 * len(a | b):
                of[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None and (least.get(root(i)) is None or x < least[root(i)]):
            least[root(i)] = x
    return sorted(((x, len(sets[i]), least.get(root(i))) for i, x in enumerate(ids)), key=str)


def edited(r, text, n):
    words = text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
    return " ".join(words)


def varied(seed=5):
    """Families of near copies at both sides of the threshold, chains, copies, shared passages, short texts."""
    r = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = rng_texts(seed, 60, 3000, (40, 200)) + ODD + ["a b", "A B", "b a", "a", "one two three", "one two three four"]
    for base in rng_texts(seed + 1, 12, 3000, (60, 250)):
        texts += [edited(r, base, r.randrange(5)) for _ in range(12)] + [base.upper()]
    chain = rng_texts(seed + 2, 1, 3000, (300, 300))[0]
    for _ in range(15):
        texts.append(chain)
        chain = edited(r, chain, 4)
    texts += [f"{passage} {x}" for x in rng_texts(seed + 3, 25, 3000, (2, 60))] + [f"{passage} q{i}" for i in range(30)]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("held, seed, few", [(1 << 20, 5, 64), (0, 6, 64), (50, 7, 4), (1 << 20, 8, 0)])
def test_jaccard_join_is_brute_force(spark, monkeypatch, held, seed, few):
    monkeypatch.setattr(jaccard_join, "HELD_SHINGLES", held)
    monkeypatch.setattr(jaccard_join, "FEW", few)
    texts = varied(seed)
    got = sorted((tuple(x) for x in jaccard_join.jaccard_components(frame(spark, texts)).collect()), key=str)
    want = brute_components(list(range(len(texts))), texts)
    assert got == want and len({x[2] for x in want}) < len(texts) - 100


def test_jaccard_join_with_ids_that_repeat_or_are_null(spark):
    texts = ["one two three four"] * 40 + [None, None, "", "five six", "five  SIX", "seven"]
    ids = [None] * 20 + [7] * 20 + [1, None, 2, None, None, None]
    got = sorted((tuple(x) for x in jaccard_join.jaccard_components(frame(spark, texts, ids=ids)).collect()), key=str)
    assert got == brute_components(ids, texts)
    assert jaccard_join.jaccard_components(frame(spark, ["x"]).limit(0)).count() == 0


def test_a_link_at_the_threshold_counts(spark):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[:36]), " ".join(words[2:38]), " ".join(words[:38]), " ".join(words[:20]), " ".join(words[:22])]  # 34 of 36 pass, 18 of 20 = 0.9 pass, 32 of 36 fail alone
    got = {x.doc_id: x.component_id for x in jaccard_join.jaccard_components(frame(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3} == {a: c for a, _, c in brute_components(list(range(5)), texts)}


def test_a_hot_group_of_near_copies_in_small_blocks(spark, monkeypatch):
    from linewise.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    r = random.Random(9)
    base = rng_texts(9, 1, 3000, (400, 400))[0]
    texts = [edited(r, base, r.randrange(4, 16)) for _ in range(120)] + rng_texts(10, 60, 3000, (30, 90))
    got = sorted((tuple(x) for x in jaccard_join.jaccard_components(frame(spark, texts)).collect()), key=str)
    assert got == brute_components(list(range(len(texts))), texts)


def test_registered_jaccard_join_over_a_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute_components([x.doc_id for x in rows], [x.text for x in rows])
    assert sorted((tuple(x) for x in queries.op13_jaccard_join(spark, SF).collect()), key=str) == want

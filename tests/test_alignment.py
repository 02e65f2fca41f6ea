"""Pairings of two versions against the plain recurrence, and their memory."""

import difflib
import random
import tracemalloc

import pytest

from linewise.operators import align, repair
from linewise.operators import lines as L
from linewise.plans import queries
from linewise.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def recurrence(n, m, alike):
    """Pairs by a table of all places: most pairs from (i, j) on; a pair whenever it can be, else down if that loses none, else right."""
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if alike(i, j) else max(best[i + 1][j], best[i][j + 1])
    found, i, j = [], 0, 0
    while i < n and j < m:
        if alike(i, j):
            found.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return found


def alike_lengths(a, b):
    return (a < 5 and b < 5) or 0.25 <= b / max(a, 1) <= 2.8


def test_pairings_are_the_recurrence():
    r = random.Random(1)
    for k in range(400):
        n, m, letters = r.randrange(30), r.randrange(30), "SC" if k % 2 else "SCPDA"
        a, b = [r.choice(letters) for _ in range(n)], [r.choice(letters) for _ in range(m)]
        assert align.pairing(n, m, align.equal_masks(a, b)) == recurrence(n, m, lambda i, j: a[i] == b[j])
        a, b = ([r.choice([0, 3, 4, 5, 10, 14, 40, 100, 300]) for _ in range(x)] for x in (n, m))
        assert align.pairing(n, m, align.length_masks(a, b)) == recurrence(n, m, lambda i, j: alike_lengths(a[i], b[j]))


def test_a_work_of_100000_blocks_takes_little_memory():
    r = random.Random(2)
    a = [r.choice("SCCP") for _ in range(100_000)]
    b = [x for x in a if r.random() > 0.1] + [r.choice("SCP") for _ in range(5_000)]
    tracemalloc.start()
    found = align.pairing(len(a), len(b), align.equal_masks(a, b))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000_000 and len(found) > 90_000 and all(a[i] == b[j] for i, j in found[::1000])
    assert all(x < y and u < v for (x, u), (y, v) in zip(found, found[1:]))


def test_narration_is_what_is_neither_speech_nor_cue(spark):
    text = "lost\n# ONE\nabc\n@A\n- hi\n(low)\n de \n# 생략\ngone\n# TWO\n\n# omitted\nx\n# THREE\n- only"
    rows = align.narration_lengths(L.to_lines(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text")).orderBy("scene_no").collect()
    assert [(x.scene_no, x.heading, x.length) for x in rows] == [(0, "# ONE", 7), (1, "# TWO", 0), (2, "# THREE", 0)]


def test_scenes_by_length_by_hand(spark):
    side = lambda sizes: spark.createDataFrame([("w", i, x) for i, x in enumerate(sizes)], "work string, scene_no long, length long")
    a, b = side([100, 0, 1000, 50]), side([90, 4, 24, 140])
    pairs = align.align_lengths(a, b)

    assert sorted(tuple(x)[1:] for x in pairs.collect()) == recurrence(4, 4, lambda i, j: alike_lengths([100, 0, 1000, 50][i], [90, 4, 24, 140][j]))
    left = sorted(tuple(x)[1:] for x in align.unpaired(pairs, a, b).collect())
    assert len(left) == 2 and left[0] == ("a", 2) and left[1][0] == "b"


def by_work(rows, *columns):
    out = {}
    for x in sorted(rows, key=lambda x: (x["work"], x[columns[0]])):
        out.setdefault(x["work"], []).append(x)
    return out


@pytest.mark.parametrize("name", ["lcs_alignment", "length_alignment"])
def test_registered_alignments_are_the_recurrence(spark, name):
    if name == "lcs_alignment":
        sides, order, value, alike = [L.typed_blocks(queries.script_lines(spark, SF, f"turn % 2 = {k}")) for k in (0, 1)], "block_no", "type", lambda x, y: x == y
    else:
        sides, order, value, alike = [queries.turn_narration(spark, SF, k) for k in (0, 1)], "scene_no", "length", alike_lengths
    a, b = (by_work(x.select("work", order, value).collect(), order) for x in sides)
    want = []
    for work in a.keys() & b.keys():
        x, y = a[work], b[work]
        want += [(work, x[i][order], y[j][order]) for i, j in recurrence(len(x), len(y), lambda i, j: alike(x[i][value], y[j][value]))]
    assert sorted(tuple(x) for x in QUERIES[name](spark, SF).collect()) == sorted(want) and len(want) > 10


def test_what_is_paired_and_what_is_left_are_all_scenes(spark):
    sides = [queries.turn_narration(spark, SF, k) for k in (0, 1)]
    pairs = QUERIES["length_alignment"](spark, SF)
    left = QUERIES["unpaired_scenes"](spark, SF).collect()
    assert sum(x.count() for x in sides) == 2 * pairs.count() + len(left) and all(x.heading.startswith("# TURN ") for x in left)


def test_readings_are_compared_word_by_word(spark):
    text = "# One  it’s 12 o'clock\n@BOB\n- well done"
    read = "ONE it's l2 clock bob well dune indeed"
    row = align.reading_accuracy(spark.createDataFrame([("w", text, read), ("n", None, "x")], "work string, reference string, reading string")).orderBy("work").collect()
    assert tuple(row[0]) == ("n", 0, 0, 0, 0, 1, 0.0)
    assert align.compared_words(text) == ["one", "it's", "12", "o'clock", "bob", "well", "done"]
    # one it's [12 o'clock | l 2 clock] bob well [done | dune indeed]
    assert tuple(row[1]) == ("w", 7, 4, 0, 0, 0, 4 / 7)


def test_no_alignment_finds_more_equal_words():
    r = random.Random(3)
    for _ in range(100):
        a, b = ([r.choice("abcdefg") for _ in range(r.randrange(40))] for _ in range(2))
        other = sum(x.size for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert len(align.pairing(len(a), len(b), align.equal_masks(a, b))) >= other


def blocks(spark, rows):
    return spark.createDataFrame([("w", i, t, x) for i, (t, x) in enumerate(rows)], "work string, block_no long, type string, text string")


def test_blocks_between_anchors_by_hand(spark):
    source = blocks(spark, [("action", "top"), ("scene", "# A"), ("action", "a1"), ("action", "a2"), ("action", "a3"), ("character", "@X"), ("paren", "(p)"), ("dialogue", "d1"), ("character", "@Y"), ("dialogue", "d2"), ("scene", "# B")])
    result = blocks(spark, [("scene", "# 가"), ("action", "1"), ("action", "2"), ("character", "@엑"), ("paren", "(피)"), ("dialogue", "3"), ("action", "4"), ("scene", "# 나"), ("action", "5")])
    got = [x.result for x in repair.realigned(source, result).orderBy("block_no").collect()]
    # three blocks share two: the second is cut at the rounded multiples of 2/3, so it stands for two; the anchor without a pair has nothing; what follows the last heading joins it
    assert got == [None, "# 가", "1", "2", "2", "@엑", "(피)", "3 4", None, None, "# 나 5"]

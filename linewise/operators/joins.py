"""Joins by position, by dictionary, by likeness and by containment.

Joins on likeness always have an equality as well: a work, a length, or a common part. None compares all rows with all.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from ..functions import text as T
from .coverage import contained_lines  # noqa: F401  (a join of lines with the text of their work)
from .likeness import nearest_lines
from .lines import scene_kinds, with_segments, words
from .names import Patterns, merged_cues  # noqa: F401  (merged_cues is a join of lines with the names of their work)


def by_position(a: DataFrame, b: DataFrame, key: str = "work", order: str = "line_no", value: str = "text") -> DataFrame:
    """(key, nth, a, b): the n-th row of a beside the n-th of b, as far as both go."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(order))
    left = a.select(key, nth.alias("nth"), F.col(value).alias("a"))
    right = b.select(key, nth.alias("nth"), F.col(value).alias("b"))
    return left.join(right, [key, "nth"])


def changed_scenes(old: DataFrame, new: DataFrame, limit: int = 4) -> DataFrame:
    """The first scenes (work, scene_no) that differ between two versions, up to `limit` a work: a report."""
    both = old.select("work", "scene_no", F.col("scene").alias("a")).join(new.select("work", "scene_no", F.col("scene").alias("b")), ["work", "scene_no"]).filter("a <> b")
    return both.withColumn("rn", F.row_number().over(W.partitionBy("work").orderBy("scene_no"))).filter(F.col("rn") <= limit).drop("rn")


def votes(pairs: DataFrame, key: Column, value: Column, by: tuple[str, ...] = ("work",)) -> DataFrame:
    """(by, key, value, votes, first): how often each value stands for a key, and where first; pairs have a column nth."""
    return pairs.groupBy(*by, key.alias("key"), value.alias("value")).agg(F.count(F.lit(1)).alias("votes"), F.min("nth").alias("first"))


def dictionary(voted: DataFrame, rule: str = "dominant", by: tuple[str, ...] = ("work",)) -> DataFrame:
    """(by, key, value, votes): the winning value of each key; of equals, the one seen first.

    `dominant`: it is the only one, or has two votes and three times the second's. `twice`: it has two votes. `top`: always.
    """
    order = W.partitionBy(*by, "key").orderBy(F.desc("votes"), "first", "value")
    ranked = voted.withColumn("rn", F.row_number().over(order)).withColumn("second", F.lead("votes").over(order)).filter("rn = 1")
    rules = {"dominant": F.col("second").isNull() | ((F.col("votes") >= 2) & (F.col("votes") >= 3 * F.col("second"))), "twice": F.col("votes") >= 2, "top": F.lit(True)}
    return ranked.filter(rules[rule]).select(*by, "key", "value", "votes")


def translated(rows: DataFrame, names: DataFrame, column: str, by: tuple[str, ...] = ("work",)) -> DataFrame:
    """rows with `column` replaced where the dictionary has it; Spark broadcasts the dictionary if it is small."""
    known = names.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("key").alias("__key"), F.col("value").alias("__value"))
    same = [rows[c].eqNullSafe(known[f"__{c}"]) for c in by]
    joined = rows.join(known, [*same, rows[column] == known["__key"]], "left")
    return joined.withColumn(column, F.coalesce("__value", column)).drop("__key", "__value", *[f"__{c}" for c in by])


def equal_structure(a: DataFrame, b: DataFrame) -> DataFrame:
    """(work, scene_no): scenes of two versions with the same kinds of lines in the same order, in works with as many scenes."""
    ka, kb = scene_kinds(a), scene_kinds(b)
    counts = ka.groupBy("work").agg(F.count(F.lit(1)).alias("na")).join(kb.groupBy("work").agg(F.count(F.lit(1)).alias("nb")), "work").filter("na = nb")
    return ka.join(kb, ["work", "scene_no", "kinds"]).join(counts, "work", "left_semi").select("work", "scene_no")


def structure_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """(work, scenes_a, scenes_b, equal, percent): how many scenes, in order, have the same kinds of lines, out of the fewer scenes."""
    ka, kb = scene_kinds(a), scene_kinds(b)
    na, nb = ka.groupBy("work").agg(F.count(F.lit(1)).alias("scenes_a")), kb.groupBy("work").agg(F.count(F.lit(1)).alias("scenes_b"))
    equal = ka.join(kb, ["work", "scene_no", "kinds"]).groupBy("work").agg(F.count(F.lit(1)).alias("equal"))
    rows = na.join(nb, "work").join(equal, "work", "left").fillna(0, ["equal"])
    return rows.withColumn("percent", F.floor(100 * F.col("equal") / F.least("scenes_a", "scenes_b")))


def aligned_cues(a: DataFrame, b: DataFrame) -> DataFrame:
    """(work, nth, a, b): speakers of two versions in scenes of equal structure, line by line."""
    same = equal_structure(a, b)
    cues = lambda v: with_segments(v, T.trim(F.col("text")).startswith("#")).filter(T.trim(F.col("text")).startswith("@")).withColumn("cue", T.cue_name(F.col("text")))
    nth = F.row_number().over(W.partitionBy("work", "scene_no").orderBy("line_no"))
    ca = cues(a).withColumn("nth", nth).select("work", "scene_no", "nth", F.col("cue").alias("a"))
    cb = cues(b).withColumn("nth", nth).select("work", "scene_no", "nth", F.col("cue").alias("b"))
    return ca.join(cb, ["work", "scene_no", "nth"]).join(same, ["work", "scene_no"], "left_semi")


def cues_by_count(a: DataFrame, b: DataFrame) -> DataFrame:
    """(work, scene_no, nth, a, b): speakers of two versions side by side in the scenes that have as many cues in both, whatever else differs."""
    name = T.trim(T.sub(T.sub(T.sub(T.trim(F.col("text")), r"^@"), r"\([^)]*\)"), r"\*"))

    def cues(v: DataFrame, side: str) -> DataFrame:
        rows = with_segments(v, T.trim(F.col("text")).startswith("#")).filter(T.trim(F.col("text")).startswith("@"))
        scene = W.partitionBy("work", "scene_no")
        return rows.select("work", "scene_no", F.row_number().over(scene.orderBy("line_no")).alias("nth"), F.count(F.lit(1)).over(scene).alias("n"), name.alias(side))

    return cues(a, "a").join(cues(b, "b"), ["work", "scene_no", "nth", "n"]).drop("n")


def speakers_agree(a: DataFrame, b: DataFrame) -> DataFrame:
    """(work, scene_no, agree): whether no speaker of a scene has another speaker's usual name of the same scene in the other version.

    The usual name of a speaker is the one it has most often in the work, in scenes with as many cues; a scene with another number of cues does not agree.
    """
    pairs = cues_by_count(a, b)
    usual = pairs.groupBy("work", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("scene_no", "nth")).alias("first"))
    usual = usual.withColumn("rn", F.row_number().over(W.partitionBy("work", "a").orderBy(F.desc("n"), "first"))).filter("rn = 1").select("work", "a", F.col("b").alias("usual"))
    named = pairs.join(usual, ["work", "a"])
    others = named.groupBy("work", "scene_no").agg(F.collect_set("usual").alias("names"))  # the speakers of one scene
    wrong = named.join(others, ["work", "scene_no"]).withColumn("wrong", (F.col("b") != F.col("usual")) & F.array_contains("names", F.col("b")))
    count = lambda v, c: with_segments(v, T.trim(F.col("text")).startswith("#")).groupBy("work", "scene_no").agg(F.sum(T.trim(F.col("text")).startswith("@").cast("int")).alias(c))
    rows = count(a, "na").join(count(b, "nb"), ["work", "scene_no"]).join(wrong.groupBy("work", "scene_no").agg(F.max(F.col("wrong").cast("int")).alias("wrong")), ["work", "scene_no"], "left")
    return rows.select("work", "scene_no", ((F.col("na") == F.col("nb")) & (F.coalesce("wrong", F.lit(0)) == 0)).alias("agree"))


def one_letter_variants(counts: DataFrame, rare: int = 3, often: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, word, n, partner, partner_n): rare words that differ from frequent ones in one letter, digits aside.

    counts has (by, word, n). Words of four or more characters meet on what is left of them without one character, at its place: words that
    share such a pattern differ in that place at most.
    """
    patterns = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.lit("\0"), F.col("word").substr(i + 1, F.length("word"))))
    holes = counts.filter(F.length("word") >= 4).select(*by, "word", "n", F.explode(patterns).alias("pattern"))
    few = holes.filter(F.col("n") <= rare)
    many = holes.filter(F.col("n") >= often).select(*by, F.col("word").alias("partner"), F.col("n").alias("partner_n"), "pattern")
    found = few.join(many, [*by, "pattern"]).filter(F.col("word") != F.col("partner")).drop("pattern").distinct()
    return found.filter(F.regexp_replace("word", "[0-9]", "0") != F.regexp_replace("partner", "[0-9]", "0"))


def shortened(word: Column, deletions: int) -> Column:
    """The different forms of a word without up to that many characters, itself included."""
    forms = F.array(word)
    for _ in range(deletions):
        cut = F.flatten(F.transform(forms, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), w.substr(i + 1, F.length(w))))))
        forms = F.array_distinct(F.concat(forms, cut))
    return forms


def near_words(a: DataFrame, b: DataFrame, distance: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a (by, word, ...) beside those of b (by, known, ...) with distance: all pairs at most `distance` edits apart.

    Two such words have a form in common that lacks up to `distance` characters of each: only words that share one are compared.
    """
    left = a.withColumn("__part", F.explode(shortened(F.col("word"), distance)))
    right = b.withColumn("__part", F.explode(shortened(F.col("known"), distance)))
    met = left.join(right, [*by, "__part"]).filter(F.abs(F.length("word") - F.length("known")) <= distance).drop("__part").distinct()
    return met.withColumn("distance", F.levenshtein("word", "known")).filter(F.col("distance") <= distance)


def vocabulary_corrections(tokens: DataFrame, by: tuple[str, ...] = ("work",), least: int = 3, times: int = 3, distance: int = 1, first: str | None = None) -> DataFrame:
    """(by, word, n, correction, correction_n): misread tokens with a known word, up to `distance` edits away, that is more than `times` as frequent.

    tokens has (by, word). Known words occur `least` times and do not look misread; the most frequent one wins, then the one nearest, then the one whose column `first` of tokens is
    least (where it appears first), then the first in order.
    """
    seen = F.min(F.col(first) if first else F.lit(0))
    counts = tokens.groupBy(*by, F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.max(T.looks_misread(F.col("word")).cast("int")).alias("odd"), seen.alias("first"))
    words = counts.filter(F.length("word") >= 3)
    odd = words.filter("odd = 1").select(*by, "word", "n")
    known = words.filter((F.col("odd") == 0) & (F.col("n") >= least)).select(*by, F.col("word").alias("known"), F.col("n").alias("known_n"), "first")
    pairs = near_words(odd, known, distance, by).filter((F.col("known_n") > times * F.col("n")) & (F.col("distance") > 0))
    order = W.partitionBy(*by, "word").orderBy(F.desc("known_n"), "distance", "first", "known")
    best = pairs.withColumn("rn", F.row_number().over(order)).filter("rn = 1")
    return best.select(*by, "word", "n", F.col("known").alias("correction"), F.col("known_n").alias("correction_n"))


def cue_corrections(cues: DataFrame, rare: int = 3, times: int = 3) -> DataFrame:
    """(work, name, n, correction, correction_n): cues (work, line_no, name) that stand `rare` times or less and differ in one letter from one of `times` as many or more.

    Of several such names the one that appears first in the work counts.
    """
    counts = cues.groupBy("work", "name").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"))
    few = counts.filter(F.col("n") <= rare).select("work", F.lower("name").alias("word"), "name", "n")
    other = counts.select("work", F.lower("name").alias("known"), F.col("name").alias("correction"), F.col("n").alias("correction_n"), "first")
    pairs = near_words(few, other, 1, ("work",)).filter((F.col("distance") == 1) & (F.length("name") == F.length("correction")) & (F.col("correction_n") >= times * F.col("n")))
    best = pairs.groupBy("work", "name", "n").agg(F.min_by(F.struct("correction", "correction_n"), "first").alias("b"))
    return best.select("work", "name", "n", "b.correction", "b.correction_n")


def single_substitutions(pairs: DataFrame, a: str, b: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Pairs of words of one length that differ in one place, by one of the allowed pairs of characters."""
    la, lb = F.split(F.lower(F.col(a)), ""), F.split(F.lower(F.col(b)), "")
    differing = F.filter(F.zip_with(la, lb, lambda x, y: F.when(x != y, F.concat(x, y))), lambda d: d.isNotNull())
    known = F.array(*[F.lit(x + y) for x, y in allowed])
    return pairs.filter((F.length(a) == F.length(b)) & (F.size(differing) == 1) & F.array_contains(known, F.element_at(differing, 1)))


#: Characters of items that are looked up by one automaton in every task (some 100 bytes each there).
SCANNED = 1 << 20


def _scanned(items: DataFrame, texts: DataFrame) -> DataFrame:
    """(item, doc) for items (item, needle) that were counted to be few, and texts (doc, hay)."""
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((items, "item"), (texts, "doc"))}
    owners: dict[str, list] = {}
    for row in items.select("item", "needle").collect():
        owners.setdefault(row.needle, []).append(row["item"])
    sent = items.sparkSession.sparkContext.broadcast(owners)

    def look_up(batches):
        found = Patterns(sent.value)
        for batch in batches:
            out = [(item, doc) for doc, hay in zip(batch.column("doc").to_pylist(), batch.column("hay").to_pylist(), strict=True) if hay for needle in found.within(hay) for item in sent.value[needle]]
            columns = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], item_type), pa.array(columns[1], batch.schema.field("doc").type)], names=["item", "doc"])

    item_type = to_arrow_type(items.schema["item"].dataType)
    return texts.mapInArrow(look_up, f"item {kinds['item']}, doc {kinds['doc']}").distinct()


def texts_containing(items: DataFrame, texts: DataFrame, item: str, doc: str, widest: int = 16) -> DataFrame:
    """(item, doc): which texts contain which items, blanks and marks aside.

    Items of `SCANNED` characters in all at most go to every task as one automaton, which reads each text once. More items are joined:
    texts are cut into blocks of `width` characters side by side. An item of 2 x width - 1 characters or more, wherever it stands in a
    text, covers a whole block, which is one of the item's own pieces at the first `width` offsets: item and text meet on
    such a piece, and only pairs that do are searched. Work on a text is linear in its length.
    """
    small = items.select(F.col(item).alias("item"), T.comparable(F.col("text")).alias("needle")).filter(F.length("needle") > 0)
    hay = texts.select(F.col(doc).alias("doc"), T.comparable(F.col("text")).alias("hay"))
    if (small.agg(F.sum(F.length("needle"))).first()[0] or 0) <= SCANNED:
        return _scanned(small, hay)
    widths = [1 << k for k in range(widest.bit_length()) if 1 << k <= widest]
    small = small.withColumn("width", F.greatest(*[F.when(F.length("needle") >= 2 * w - 1, w).otherwise(0) for w in widths], F.lit(1)))
    used = sorted(r.width for r in small.select("width").distinct().collect())  # a few powers of two
    if not used:
        return small.join(hay, F.lit(False)).select("item", "doc")
    pieces = F.transform(F.sequence(F.lit(1), F.col("width")), lambda k: F.col("needle").substr(k, F.col("width")))
    own = small.select("item", "width", F.explode(F.array_distinct(pieces)).alias("piece"))
    blocks = lambda w: F.transform(F.regexp_extract_all("hay", F.lit(f".{{{w}}}"), F.lit(0)), lambda p: F.struct(F.lit(w).alias("width"), p.alias("piece")))
    cut = hay.select("doc", F.explode(F.array_distinct(F.concat(*map(blocks, used)))).alias("b")).select("doc", "b.width", "b.piece")
    met = cut.join(own, ["width", "piece"]).select("item", "doc").distinct()
    pairs = met.join(small.select("item", "needle"), "item")
    return pairs.join(hay, "doc").filter(F.contains("hay", "needle")).select("item", "doc")


def fuzzy_lines(wanted: DataFrame, lines: DataFrame, least: float = 0.7, on: str = "work") -> DataFrame:
    """(on, item, line_no, similarity): for each wanted text the line of the work that is it, or else the most alike by pairs of characters.

    Different texts meet on rare pairs. With the pairs of a text in one order for all, the rarest first, two texts of n pairs or fewer that are alike at
    `least` share one of the first n - ceil(least x n) + 1 pairs of each: only those are compared. All that is shuffled are the texts and lines, by work.
    """
    trimmed = lambda rows, number: rows.filter(F.col(on).isNotNull()).select(on, number, T.trim(F.coalesce("text", F.lit(""))).alias("text"))
    near = nearest_lines(trimmed(wanted, "item"), trimmed(lines, "line_no").filter("text <> ''"), least, on)
    best = near.groupBy(on, "item").agg(F.max_by(F.struct("line_no", "similarity"), F.struct("similarity", -F.col("line_no"))).alias("b"))
    return best.select(on, "item", "b.line_no", F.least(F.lit(1.0), F.col("b.similarity")).alias("similarity"))


def replace_once(text: Column, old: Column, new: Column) -> Column:
    """The text with old replaced, if it occurs exactly once; else unchanged."""
    times = (F.length(text) - F.length(F.replace(text, old, F.lit("")))) / F.nullif(F.length(old), F.lit(0))
    return F.when(times == 1, F.replace(text, old, new)).otherwise(text)


def lost_words(source: DataFrame, result: DataFrame, on: str = "work") -> DataFrame:
    """(on, word, lost): how many more times the source has each word than the result; both have (on, word)."""
    s = source.groupBy(on, "word").agg(F.count(F.lit(1)).alias("s"))
    r = result.groupBy(on, "word").agg(F.count(F.lit(1)).alias("r"))
    return s.join(r, [on, "word"], "left").select(on, "word", (F.col("s") - F.coalesce("r", F.lit(0))).alias("lost")).filter("lost > 0")


def lost_numbers(source: DataFrame, result: DataFrame) -> DataFrame:
    """(work, word): numbers of two or more digits that a work has in the source alone; both have (work, text)."""
    numbers = lambda df: words(df, "work", "text", r"\d{2,}").distinct()
    return numbers(source).subtract(numbers(result))


def paired_files(files: DataFrame) -> DataFrame:
    """(base, formatted, translated, pdf): files (path) of one work side by side, by their names without folder, suffix and case."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    base = F.lower(T.trim(F.regexp_replace(F.regexp_replace(name, r"(?i)(_formatted|_translated)?\.(txt|pdf|rtf|fdx)$", ""), r"[_\s]+", " ")))
    rows = files.withColumn("name", name).withColumn("base", base)
    pick = lambda cond: F.min(F.when(cond, F.col("path")))
    return rows.groupBy("base").agg(
        pick(F.col("name").rlike("(?i)_formatted\\.txt$")).alias("formatted"), pick(F.col("name").rlike("(?i)_translated\\.txt$")).alias("translated"),
        pick(F.col("name").rlike("(?i)\\.pdf$")).alias("pdf"),
    )

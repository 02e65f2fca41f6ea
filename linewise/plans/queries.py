"""The library's operators over the given tables, each with the same computation in SQL where SQL can say it.

Scripts are rendered from conversations: a conversation is a work with a heading, a turn is a cue with its speech. Documents give
lines, pages give markup, events give states over time. Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import ERRORS
from ..operators import align, clean, incremental, joins, quality, selection, windows
from ..operators import lines as L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, and its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return L.to_lines(table(spark, sf_dir, "documents"), "doc_id", "text", *keep)


def scripts(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter(where)
    piece = F.concat(F.lit("@"), "role", F.lit("\n- "), F.coalesce("text", F.lit("")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", piece.alias("p")))), lambda x: x["p"])
    rows = turns.groupBy(F.col("conv_id").alias("work")).agg(F.array_join(ordered, "\n\n").alias("body"))
    return rows.select("work", F.concat(F.lit("# CONV "), "work", F.lit("\n\n"), "body").alias("text"))


def script_lines(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return L.to_lines(scripts(spark, sf_dir, where), "work", "text")


# --- pieces of SQL -------------------------------------------------------------------------------------------------------


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _script(name: str = "l", where: str = "true") -> str:
    return f"""s_{name} AS (SELECT conv_id AS work, '# CONV ' || conv_id || chr(10) || chr(10)
  || string_agg('@' || role || chr(10) || '- ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE {where} GROUP BY conv_id),
{name} AS (SELECT work, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS text FROM s_{name})"""


_DOCS = """l AS (SELECT doc_id AS work, source, lang, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no,
  unnest(string_split(text, chr(10))) AS text FROM documents)"""
_T = f"t AS (SELECT *, {_trim('text')} AS tr FROM l)"
_KIND = """CASE WHEN starts_with(tr, '#') THEN 'S' WHEN starts_with(tr, '@') THEN 'C' WHEN starts_with(tr, '- ') THEN 'D'
  WHEN starts_with(tr, '(') AND ends_with(tr, ')') THEN 'P' ELSE 'A' END"""
_DIALOGUE = """g AS (SELECT *, sum(CASE WHEN tr LIKE '@%' OR tr LIKE '#%' THEN 1 ELSE 0 END) OVER (PARTITION BY work ORDER BY line_no) AS seg,
  tr <> '' AND NOT regexp_matches(tr, '^[(@#]') AS said FROM t),
h AS (SELECT *, first_value(tr LIKE '@%') OVER (PARTITION BY work, seg ORDER BY line_no) AS after_cue,
  min(CASE WHEN said THEN line_no END) OVER (PARTITION BY work, seg) AS first_said FROM g),
i AS (SELECT *, min(CASE WHEN tr = '' AND line_no > first_said THEN line_no END) OVER (PARTITION BY work, seg) AS closed FROM h),
d AS (SELECT *, after_cue AND said AND (closed IS NULL OR line_no < closed) AS in_dialogue FROM i)"""


def _words(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '\S+'))"


# --- lines and windows ---------------------------------------------------------------------------------------------------


@query(f"""WITH {_DOCS}, {_T}, p AS (SELECT *, lag(tr) OVER (PARTITION BY work ORDER BY line_no) AS prev FROM t)
SELECT source, count(*) AS n FROM p WHERE tr <> '' AND tr = prev GROUP BY source""")
def dup_adjacent_lines(spark, sf_dir):
    """How many lines of each source repeat the line before them."""
    return windows.repeated_neighbours_in(table(spark, sf_dir, "documents"), "doc_id", "text", "source").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_DOCS}, {_T} SELECT work, tr AS text, count(*) AS n FROM t WHERE tr <> '' GROUP BY work, tr HAVING count(*) >= 3")
def repeated_lines_ge3(spark, sf_dir):
    return clean.repeated_lines(document_lines(spark, sf_dir))


@query(f"""WITH {_script()}, {_T}, b AS (SELECT *, tr <> '' AND coalesce(lag(tr) OVER (PARTITION BY work ORDER BY line_no), '') = '' AS starts FROM t),
n AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY work ORDER BY line_no) - 1 AS block_no FROM b)
SELECT work, CAST(block_no AS BIGINT) AS block_no, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_lines FROM n WHERE tr <> '' GROUP BY work, block_no""")
def blocks_from_conversations(spark, sf_dir):
    return L.to_blocks(script_lines(spark, sf_dir)).select("work", "block_no", "first_line", "last_line", F.size("lines").cast("long").alias("n_lines"))


@query(f"""WITH {_script()}, {_T}, k AS (SELECT *, {_KIND} AS kind, sum(CASE WHEN tr LIKE '#%' THEN 1 ELSE 0 END) OVER (PARTITION BY work ORDER BY line_no) - 1 AS scene_no FROM t)
SELECT work, CAST(scene_no AS BIGINT) AS scene_no, string_agg(kind, '' ORDER BY line_no) AS kinds FROM k WHERE tr <> '' GROUP BY work, scene_no""")
def scene_signatures(spark, sf_dir):
    return L.scene_kinds(script_lines(spark, sf_dir))


def _kinds(name: str) -> str:
    return f"""k_{name} AS (SELECT work, scene_no, string_agg(kind, '' ORDER BY line_no) AS kinds FROM (
  SELECT *, {_KIND} AS kind, sum(CASE WHEN tr LIKE '#%' THEN 1 ELSE 0 END) OVER (PARTITION BY work ORDER BY line_no) - 1 AS scene_no
  FROM (SELECT *, {_trim('text')} AS tr FROM {name})) WHERE tr <> '' GROUP BY work, scene_no)"""


@query(f"""WITH {_script('a', 'turn % 2 = 0')}, {_script('b', 'turn % 2 = 1')}, {_kinds('a')}, {_kinds('b')},
na AS (SELECT work, count(*) AS scenes_a FROM k_a GROUP BY work), nb AS (SELECT work, count(*) AS scenes_b FROM k_b GROUP BY work),
e AS (SELECT a.work, count(*) AS n FROM k_a a JOIN k_b b ON a.work = b.work AND a.scene_no = b.scene_no AND a.kinds = b.kinds GROUP BY a.work)
SELECT na.work, scenes_a, scenes_b, coalesce(n, 0) AS equal, CAST(floor(100 * coalesce(n, 0) / least(scenes_a, scenes_b)) AS BIGINT) AS percent
FROM na JOIN nb USING (work) LEFT JOIN e USING (work)""")
def struct_match_pct(spark, sf_dir):
    return joins.structure_match(script_lines(spark, sf_dir, "turn % 2 = 0"), script_lines(spark, sf_dir, "turn % 2 = 1"))


@query(rf"""WITH {_DOCS}, {_T}, b AS (SELECT *, tr <> '' AND NOT regexp_matches(tr, '^[#@(-]') AS body FROM t),
o AS (SELECT *, body AND NOT regexp_matches(tr, '[.!?…:;"''’”)\]]$') AS opens, body AND NOT regexp_matches(tr, '^[-•*]') AS goes_on FROM b),
j AS (SELECT *, coalesce(lag(opens) OVER (PARTITION BY work ORDER BY line_no), false) AND goes_on AS joins FROM o),
i AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY work ORDER BY line_no) AS island,
  coalesce(lead(joins) OVER (PARTITION BY work ORDER BY line_no), false) AS next_joins FROM j)
SELECT work, min(line_no) AS line_no, string_agg(CASE WHEN joins THEN tr WHEN next_joins THEN regexp_replace(text, '\s+$', '') ELSE text END, ' ' ORDER BY line_no) AS text,
  count(*) AS joined FROM i GROUP BY work, island""")
def reflow_lines(spark, sf_dir):
    return windows.reflow(document_lines(spark, sf_dir)).select("work", "line_no", "text", "joined")


@query(rf"""WITH {_script()}, {_T}, f AS (SELECT *, lag(line_no) OVER (PARTITION BY work ORDER BY line_no) AS last FROM t WHERE tr <> '')
SELECT work, line_no, regexp_replace(text, '\s+$', '') AS text, coalesce(last IS NOT NULL AND (line_no - last > 1 OR regexp_matches(tr, '^[#@]')), false) AS gap FROM f""")
def normalize_spacing(spark, sf_dir):
    return windows.normal_spacing(script_lines(spark, sf_dir)).select("work", "line_no", "text", "gap")


@query(f"""WITH {_script()}, {_T}, {_DIALOGUE}
SELECT work, CAST(sum(CASE WHEN in_dialogue THEN 1 ELSE 0 END) AS BIGINT) AS dialogue, CAST(sum(CASE WHEN in_dialogue THEN 0 ELSE 1 END) AS BIGINT) AS action,
  CAST(coalesce(sum(CASE WHEN NOT in_dialogue THEN {_words('text')} END), 0) AS BIGINT) AS action_words FROM d WHERE said GROUP BY work""")
def dialogue_action_ratio(spark, sf_dir):
    return windows.dialogue_measures(script_lines(spark, sf_dir))


@query(rf"""WITH {_script()}, {_T}, n AS (SELECT *, lead(tr) OVER (PARTITION BY work ORDER BY line_no) AS nx, regexp_matches(tr, '^[@#]') OR tr = '' AS stops FROM t),
s AS (SELECT *, sum(CASE WHEN stops THEN 1 ELSE 0 END) OVER (PARTITION BY work ORDER BY line_no) AS stretch FROM n),
o AS (SELECT *, first_value(tr LIKE '@%') OVER (PARTITION BY work, stretch ORDER BY line_no) AS opened FROM s)
SELECT work, min(line_no) AS line_no FROM o WHERE opened AND NOT stops AND NOT regexp_matches(tr, '^[(\[]') AND nx <> '' AND NOT regexp_matches(nx, '^(@|\(|#|\[|- )')
GROUP BY work, stretch""")
def missing_blank_after_dialogue(spark, sf_dir):
    return windows.missing_blank_after_dialogue(script_lines(spark, sf_dir)).select("work", "line_no")


_NEXT = """n AS (SELECT *, first_value(CASE WHEN tr <> '' AND tr NOT LIKE '(%' THEN tr END IGNORE NULLS)
  OVER (PARTITION BY work ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM t)"""


@query(f"""WITH {_script()}, {_T}, {_NEXT} SELECT work, line_no, {_trim("split_part(regexp_replace(tr, '^@', ''), '(', 1)")} AS cue, substr(nx, 1, 80) AS speech FROM n
WHERE tr LIKE '@%' AND nx IS NOT NULL AND NOT regexp_matches(nx, '^[@#]')""")
def first_speech(spark, sf_dir):
    return windows.first_speech(script_lines(spark, sf_dir))


@query(f"""WITH {_DOCS}, {_T}, c AS (SELECT *, len(regexp_extract_all(tr, '[A-Z]')) AS up, len(regexp_extract_all(tr, '[A-Za-z]')) AS al FROM t)
SELECT work, line_no, tr AS text FROM c WHERE length(tr) BETWEEN 2 AND 70 AND al > 0 AND up / al >= 0.9""")
def upper_candidates(spark, sf_dir):
    """Short lines in capitals: candidates for headings."""
    t = T.trim(F.col("text"))
    return document_lines(spark, sf_dir).filter(F.length(t).between(2, 70) & (T.upper_ratio(t) >= 0.9)).select("work", "line_no", t.alias("text"))


@query(r"""WITH l AS (SELECT page_id AS work, generate_subscripts(string_split(html, chr(10)), 1) - 1 AS line_no, unnest(string_split(html, chr(10))) AS text FROM pages),
c AS (SELECT work, length(text) - length(ltrim(text, ' ')) AS indent, count(*) AS n, min(line_no) AS f FROM l WHERE regexp_matches(text, '\S') GROUP BY 1, 2)
SELECT work, indent, n FROM (SELECT *, row_number() OVER (PARTITION BY work ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1""")
def indent_mode(spark, sf_dir):
    return clean.indent_mode(L.to_lines(table(spark, sf_dir, "pages"), "page_id", "html")).select("work", "indent", "n")


@query(f"""WITH d AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents),
l AS (SELECT doc_id AS work, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS text FROM d), {_T},
b AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY line_no) - 1 AS block_no FROM t WHERE tr <> ''),
f AS (SELECT * FROM b WHERE length(regexp_replace(tr, '\\s', '', 'g')) >= 20),
n AS (SELECT *, coalesce(tr = lag(tr) OVER w AND block_no - lag(block_no) OVER w = 1, false) AS same FROM f WINDOW w AS (PARTITION BY work ORDER BY block_no)),
i AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY work ORDER BY block_no) AS island FROM n),
r AS (SELECT *, count(*) OVER (PARTITION BY work, island) AS run, row_number() OVER (PARTITION BY work, island ORDER BY block_no) AS rn FROM i)
SELECT work, block_no, line_no AS first_line, line_no AS last_line FROM r WHERE run >= 3 AND rn > 1""".replace("\\\\s", "\\s"))
def repeat_block_runs(spark, sf_dir):
    """Blocks that repeat three times or more in a row; each line of a document is a block."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return windows.repeated_blocks(L.to_lines(docs, "doc_id", "text"))


_SCENES = "c AS (SELECT conv_id AS work, turn AS scene_no, coalesce(text, '') AS scene FROM conversations)"


def turn_scenes(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("work"), F.col("turn").alias("scene_no"), F.coalesce("text", F.lit("")).alias("scene"))


@query(rf"""WITH {_SCENES}, f AS (SELECT *, list_filter(list_transform(string_split(scene, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM c),
a AS (SELECT *, array_to_string(ls[greatest(len(ls) - 2, 1):len(ls)], ' ') AS tail FROM f)
SELECT work, scene_no, right(lag(tail) OVER (PARTITION BY work ORDER BY scene_no), 220) AS before FROM a""")
def previous_tail(spark, sf_dir):
    return windows.previous_tail(turn_scenes(spark, sf_dir)).select("work", "scene_no", "before")


@query(f"""WITH {_script()}, {_T}, {_DIALOGUE},
y AS (SELECT *, CASE WHEN tr LIKE '#%' THEN 'scene' WHEN tr LIKE '@%' THEN 'character' WHEN tr LIKE '(%' AND tr LIKE '%)' THEN 'paren'
  WHEN in_dialogue OR tr LIKE '- %' THEN 'dialogue' ELSE 'action' END AS type FROM d WHERE tr <> ''),
q AS (SELECT *, coalesce(type IN ('scene', 'character', 'paren') OR type <> lag(type) OVER w OR line_no - lag(line_no) OVER w > 1, true) AS apart FROM y WINDOW w AS (PARTITION BY work ORDER BY line_no)),
r AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY work ORDER BY line_no) - 1 AS block_no FROM q)
SELECT work, CAST(block_no AS BIGINT) AS block_no, min(type) AS type, string_agg(tr, ' ' ORDER BY line_no) AS text FROM r GROUP BY work, block_no""")
def typed_blocks(spark, sf_dir):
    return L.typed_blocks(script_lines(spark, sf_dir))


@query(rf"""WITH {_SCENES} SELECT work, count(*) AS scenes, avg(length(scene)) AS avg_len, max(length(scene)) AS max_len,
  CAST((avg(length(scene)) > 3200)::INT + (max(length(scene)) > 20000)::INT AS BIGINT) AS n_flags FROM c GROUP BY work""")
def scene_length_flags(spark, sf_dir):
    rows = quality.scene_lengths(turn_scenes(spark, sf_dir))
    return rows.select("work", "scenes", "avg_len", F.col("max_len").cast("long").alias("max_len"), F.size("flags").cast("long").alias("n_flags"))


@query("""WITH l AS (SELECT doc_id AS work, generate_subscripts(string_split(text, ' '), 1) - 1 AS block_no, unnest(string_split(text, ' ')) AS text FROM documents),
s AS (SELECT *, sum(length(text)) OVER (PARTITION BY work) AS size, coalesce(sum(length(text)) OVER (PARTITION BY work ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
SELECT work, CAST(before >= size / 2 AS INT) AS half, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars FROM s GROUP BY 1, 2""")
def halves_by_size(spark, sf_dir):
    """Each document's words cut in two where half of its characters are reached."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("work"), F.posexplode(F.split("text", " ")).alias("block_no", "text"))
    return L.halves_by_size(rows).groupBy("work", "half").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(f"""WITH {_DOCS}, p AS (SELECT *, line_no // 10 AS page FROM l WHERE regexp_matches(text, '\\S')),
k AS (SELECT *, row_number() OVER (PARTITION BY work, page ORDER BY line_no) AS down, row_number() OVER (PARTITION BY work, page ORDER BY line_no DESC) AS up FROM p),
s AS (SELECT DISTINCT work, page, {_trim("regexp_replace(regexp_replace(regexp_replace(lower(" + _trim("text") + "), '[0-9]+', ' ', 'g'), '[\\[\\]().,/''\"“”\\-–—:!?]', ' ', 'g'), '\\s+', ' ', 'g')")} AS key FROM k WHERE down <= 2 OR up <= 2),
n AS (SELECT work, count(DISTINCT line_no // 10) AS pages FROM l GROUP BY work)
SELECT s.work, key, count(*) AS pages FROM s JOIN n ON s.work = n.work WHERE length(key) >= 3 GROUP BY s.work, key, n.pages HAVING count(*) >= greatest(3, ceil(n.pages * 0.2))""")
def edge_headers(spark, sf_dir):
    """Signatures that return at the edges of pages of ten lines."""
    return clean.edge_headers(document_lines(spark, sf_dir).withColumn("page", F.floor(F.col("line_no") / 10)))


# --- joins ----------------------------------------------------------------------------------------------------------------


@query(r"""WITH s AS (SELECT lang, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z]*')) AS word FROM documents WHERE doc_id % 2 = 0),
r AS (SELECT lang, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z]*')) AS word FROM documents WHERE doc_id % 2 = 1),
a AS (SELECT lang, word, count(*) AS n FROM s GROUP BY ALL), b AS (SELECT lang, word, count(*) AS m FROM r GROUP BY ALL)
SELECT lang, word, n - coalesce(m, 0) AS lost FROM a LEFT JOIN b USING (lang, word) WHERE n > coalesce(m, 0)""")
def word_loss_multiset(spark, sf_dir):
    """Words that even-numbered documents of a language have more often than odd-numbered ones: two halves of the corpus as source and result."""
    docs = table(spark, sf_dir, "documents")
    tokens = L.words(docs.withColumn("half", F.struct("lang", (F.col("doc_id") % 2).alias("odd"))), "half", "text", "[A-Za-z][A-Za-z]*")
    tokens = tokens.select(F.col("work.lang").alias("lang"), F.col("work.odd").alias("odd"), "word")
    return joins.lost_words(tokens.filter("odd = 0"), tokens.filter("odd = 1"), "lang")


@query("""WITH b AS (SELECT item_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS needle FROM benchmark),
d AS (SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS hay FROM documents)
SELECT item_id AS item, doc_id AS doc FROM b JOIN d ON contains(hay, needle) WHERE needle <> ''""")
def coverage_contains(spark, sf_dir):
    """Which documents contain which benchmark texts, whatever their marks and blanks."""
    return joins.texts_containing(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id")


@query(r"""WITH w AS (SELECT lang, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS word FROM documents),
c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL HAVING length(word) >= 4)
SELECT a.lang, a.word, a.n, b.word AS partner, b.n AS partner_n FROM c a JOIN c b ON a.lang = b.lang AND length(a.word) = length(b.word) AND a.n <= 3 AND b.n >= 5
WHERE hamming(a.word, b.word) = 1 AND regexp_replace(a.word, '[0-9]', '0', 'g') <> regexp_replace(b.word, '[0-9]', '0', 'g')""")
def spelling_variants(spark, sf_dir):
    tokens = L.words(table(spark, sf_dir, "documents"), "lang", "text", "[A-Za-z0-9]+").withColumnRenamed("work", "lang")
    return joins.one_letter_variants(tokens.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), by=("lang",))


@query(r"""WITH w AS (SELECT source, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents),
c AS (SELECT source, lower(word) AS word, count(*) AS n, max(CASE WHEN length(word) >= 3 AND (NOT regexp_matches(word, '[aeiouyAEIOUY]')
  OR regexp_matches(word, '[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ]{5}') OR regexp_matches(word, '[a-z][A-Z]')) THEN 1 ELSE 0 END) AS odd FROM w GROUP BY 1, 2),
p AS (SELECT a.source, a.word, a.n, b.word AS correction, b.n AS correction_n, row_number() OVER (PARTITION BY a.source, a.word ORDER BY b.n DESC, b.word) AS rn
  FROM c a JOIN c b ON a.source = b.source AND a.odd = 1 AND b.odd = 0 AND b.n >= 3 AND b.n > 3 * a.n AND length(a.word) >= 3 AND length(b.word) >= 3
  AND abs(length(a.word) - length(b.word)) <= 1 AND levenshtein(a.word, b.word) = 1)
SELECT source, word, n, correction, correction_n FROM p WHERE rn = 1""")
def vocab_correction(spark, sf_dir):
    tokens = L.words(table(spark, sf_dir, "documents"), "source", "text", "[A-Za-z]+").withColumnRenamed("work", "source")
    return joins.vocabulary_corrections(tokens, by=("source",))


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM benchmark)
SELECT a.word, b.word AS known, levenshtein(a.word, b.word) AS distance FROM w a JOIN w b ON levenshtein(a.word, b.word) BETWEEN 1 AND 2""")
def words_two_edits_apart(spark, sf_dir):
    """Words of the benchmark that are one or two edits apart."""
    words = L.words(table(spark, sf_dir, "benchmark").withColumn("text", F.lower("text")), "item_id", "text", "[a-z]{3,}").select("word").distinct()
    return joins.near_words(words, words.select(F.col("word").alias("known")), 2).filter("distance > 0")


@query("""WITH v AS (SELECT source AS key, lang AS value, count(*) AS votes, min(doc_id) AS f FROM documents GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS rn, lead(votes) OVER w AS second FROM v WINDOW w AS (PARTITION BY key ORDER BY votes DESC, f, value))
SELECT key, value, votes FROM r WHERE rn = 1 AND (second IS NULL OR (votes >= 2 AND votes >= 3 * second))""")
def vote_dictionary(spark, sf_dir):
    """The language of each source, where the vote is clear."""
    pairs = table(spark, sf_dir, "documents").withColumn("nth", F.col("doc_id"))
    return joins.dictionary(joins.votes(pairs, F.col("source"), F.col("lang"), by=()), by=())


@query(f"""WITH {_script('a', 'turn % 2 = 0')}, {_script('b', 'turn % 2 = 1')},
x AS (SELECT work, row_number() OVER (PARTITION BY work ORDER BY line_no) AS nth, text AS a FROM a), y AS (SELECT work, row_number() OVER (PARTITION BY work ORDER BY line_no) AS nth, text AS b FROM b)
SELECT x.work, CAST(x.nth AS INT) AS nth, a, b FROM x JOIN y ON x.work = y.work AND x.nth = y.nth""")
def lines_by_position(spark, sf_dir):
    return joins.by_position(script_lines(spark, sf_dir, "turn % 2 = 0"), script_lines(spark, sf_dir, "turn % 2 = 1"))


def _bigrams(x: str) -> str:
    s = rf"regexp_replace({x}, '\s', '', 'g')"
    return f"list_distinct(list_transform(range(1, length({s})), lambda i: substr({s}, i, 2)))"


@query(f"""WITH {_script()}, {_T}, w AS (SELECT conv_id AS work, turn AS item, {_trim("coalesce(text, '')")} AS w FROM conversations),
wb AS (SELECT *, {_bigrams('w')} AS wb FROM w), tb AS (SELECT work, line_no, tr, {_bigrams('tr')} AS tb FROM t WHERE tr <> ''),
p AS (SELECT work, item, line_no, CASE WHEN w = tr THEN 2.0 WHEN len(wb) + len(tb) = 0 THEN 0.0
  ELSE len(list_intersect(wb, tb)) / (len(wb) + len(tb) - len(list_intersect(wb, tb))) END AS s FROM wb JOIN tb USING (work)),
r AS (SELECT *, row_number() OVER (PARTITION BY work, item ORDER BY s DESC, line_no) AS rn FROM p WHERE s >= 0.7)
SELECT work, item, line_no, least(1.0, s) AS similarity FROM r WHERE rn = 1""")
def fuzzy_line_match(spark, sf_dir):
    """For each turn the line of its script that is it, or is most like it."""
    wanted = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("work"), F.col("turn").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    return joins.fuzzy_lines(wanted, script_lines(spark, sf_dir))


@query("""WITH k AS (SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS key FROM documents)
SELECT md5(key) AS key, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM k GROUP BY key HAVING count(*) > 1""")
def dedupe_by_normalized_key(spark, sf_dir):
    rows = quality.duplicates_by_key(table(spark, sf_dir, "documents"), T.comparable(F.col("text")), "doc_id")
    return rows.select(F.md5("key").alias("key"), "n", "first_id", "last_id")


@query("""SELECT a.conv_id AS work, a.turn AS scene_no FROM (SELECT *, row_number() OVER (PARTITION BY a.conv_id ORDER BY a.turn) AS rn FROM conversations a JOIN conversations b
  ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn WHERE coalesce(a.text, '') <> coalesce(b.text, '')) a WHERE rn <= 4""")
def changed_scenes(spark, sf_dir):
    """The first four turns of a conversation that differ from the next: the next turns are taken for a new version."""
    scenes = turn_scenes(spark, sf_dir)
    return joins.changed_scenes(scenes, scenes.withColumn("scene_no", F.col("scene_no") - 1)).select("work", "scene_no")


# --- quality --------------------------------------------------------------------------------------------------------------


@query(rf"""WITH {_script()}, {_T}, {_DIALOGUE},
m AS (SELECT work, CAST(sum(regexp_matches(text, '^#\s')::INT) AS BIGINT) AS scenes, CAST(sum((text LIKE '@%')::INT) AS BIGINT) AS cues, sum(regexp_matches(text, '^@[^A-Z가-힣]')::INT) AS broken,
  sum((tr <> '')::INT) AS full_lines, sum((tr <> '' AND regexp_matches(text, '[\^~|\\]') AND NOT regexp_matches(text, '[가-힣]{{2,}}|[A-Za-z]{{4,}}'))::INT) AS noise FROM t GROUP BY work),
x AS (SELECT work, sum(in_dialogue::INT) AS dlg, sum((NOT in_dialogue)::INT) AS act, sum(CASE WHEN NOT in_dialogue THEN {_words('text')} ELSE 0 END) AS aw FROM d WHERE said GROUP BY work)
SELECT work, scenes, cues, coalesce(broken / nullif(cues, 0), 0.0) AS broken_cue_ratio, coalesce(noise / nullif(full_lines, 0), 0.0) AS noise_ratio,
  coalesce(dlg / nullif(dlg + act, 0), 0.0) AS dialogue_ratio, coalesce(aw / nullif(act, 0), 0.0) AS avg_action_words FROM m LEFT JOIN x USING (work)""")
def quality_metrics(spark, sf_dir):
    return quality.metrics(script_lines(spark, sf_dir)).drop("songs", "credits")


@query(rf"""WITH {_DOCS}, c AS (SELECT work, count(*) AS n_lines, CAST(sum(len(regexp_extract_all(text, '[가-힣]'))) AS BIGINT) AS hangul, CAST(sum(len(regexp_extract_all(text, '[A-Za-z]'))) AS BIGINT) AS latin FROM l GROUP BY work)
SELECT *, CASE WHEN hangul / nullif(hangul + latin, 0) > 0.2 THEN 'ko' WHEN latin > 0 THEN 'en' ELSE 'unknown' END AS lang FROM c""")
def char_class_language(spark, sf_dir):
    return quality.language_info(document_lines(spark, sf_dir))


@query(f"""WITH p AS (SELECT doc_id, source, {_words('text')} AS words, length(text) AS chars, len(regexp_extract_all(text, '[^\\x09\\x0A\\x0D\\x20-\\x7E가-힣\\x{{A0}}-\\x{{24F}}\\x{{2010}}-\\x{{2027}}\\x{{2030}}-\\x{{205E}}]')) AS odd FROM documents),
c AS (SELECT *, CASE WHEN floor(odd / greatest(chars, 1) * 1000 + 0.5) / 10 > 1.5 THEN 'C' WHEN words > 60 THEN 'A' ELSE 'B' END AS cls FROM p)
SELECT source, cls, count(*) AS n, avg(words) AS avg_words FROM c GROUP BY source, cls""")
def long_text_class(spark, sf_dir):
    """Documents by class: odd characters, long, or neither."""
    odd = F.regexp_count("text", F.lit(r"[^\x09\x0A\x0D\x20-\x7E가-힣\x{A0}-\x{24F}\x{2010}-\x{2027}\x{2030}-\x{205E}]"))
    pct = T.round_half_up(odd / F.greatest(F.length("text"), F.lit(1)) * 1000) / 10
    words = F.regexp_count("text", F.lit(r"\S+"))
    rows = table(spark, sf_dir, "documents").select("source", words.alias("words"), F.when(pct > 1.5, "C").when(words > 60, "A").otherwise("B").alias("cls"))
    return rows.groupBy("source", "cls").agg(F.count(F.lit(1)).alias("n"), F.avg("words").alias("avg_words"))


@query("""SELECT l.quality, l.toxic, d.lang, count(*) AS n, avg(length(d.text)) AS avg_chars FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL""")
def quality_by_label(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").groupBy("quality", "toxic", "lang").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("avg_chars"))


@query(rf"""WITH f AS (SELECT conv_id AS work, turn AS scene_no, coalesce(text, '') AS a, lead(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
c AS (SELECT *, len(list_filter(string_split(a, chr(10)), lambda x: regexp_matches(x, '\S'))) AS na, len(list_filter(string_split(b, chr(10)), lambda x: regexp_matches(x, '\S'))) AS nb FROM f WHERE b IS NOT NULL)
SELECT work, scene_no, regexp_matches(b, '\S') AND len(regexp_extract_all(a, '(?m)^#')) = len(regexp_extract_all(b, '(?m)^#'))
  AND len(regexp_extract_all(b, '(?m)^@')) <= len(regexp_extract_all(a, '(?m)^@')) AND (len(regexp_extract_all(a, '(?m)^@')) = 0 OR len(regexp_extract_all(b, '(?m)^@')) >= 0.5 * len(regexp_extract_all(a, '(?m)^@')))
  AND (na = 0 OR (nb >= na * 0.6 AND nb <= na * 1.6)) AS agrees FROM c""")
def structure_check(spark, sf_dir):
    """Whether each turn could be a version of the one before: as many headings, cues and about as many lines."""
    from pyspark.sql.window import Window as W

    rows = turn_scenes(spark, sf_dir).withColumn("b", F.lead("scene").over(W.partitionBy("work").orderBy("scene_no"))).filter("b IS NOT NULL")
    return rows.select("work", "scene_no", quality.structure_agrees(F.col("scene"), F.col("b")).alias("agrees"))


@query(f"""WITH {_DOCS}, {_T}, p AS (SELECT *, lag(tr) OVER (PARTITION BY work ORDER BY line_no) AS prev FROM t),
f AS (SELECT work, 'dupe' AS category FROM p WHERE tr <> '' AND tr = prev
 UNION ALL SELECT work, 'spacing' FROM p WHERE regexp_matches(tr, '^[#@]') AND prev <> ''
 UNION ALL SELECT work, CASE WHEN NOT regexp_matches(tr, '[a-z]') OR regexp_matches(tr, '^\\(.+\\)$') OR regexp_matches(tr, '^["''].*["'']$') OR regexp_matches(tr, '\\b(POV|O\\.S\\.|V\\.O\\.)\\b') THEN 'struct' ELSE 'dialog' END
 FROM p WHERE tr <> '' AND len(regexp_extract_all(tr, '[A-Za-z]')) >= 10 AND NOT regexp_matches(tr, '[가-힣]') AND NOT regexp_matches(tr, '^[#@]')
 AND NOT regexp_matches(tr, '(?i)^\\[(크레딧|자막|CREDIT|SUPER)') AND NOT regexp_matches(tr, '(?i)^(CUT TO|FADE|DISSOLVE|SMASH CUT|MATCH CUT|암전|검은 ?화면)')
 UNION ALL SELECT work, 'headNum' FROM p WHERE tr LIKE '#%' AND regexp_matches(tr, '[가-힣\\s)\\]][0-9]{{1,3}}$') AND NOT regexp_matches(tr, '(19|20)[0-9]{{2}}$')
 UNION ALL SELECT work, 'miscue' FROM p WHERE tr LIKE '@%' AND (regexp_matches(tr, '[-–—]\\s*$') OR {_words("regexp_replace(tr, '^@', '')")} >= 4))
SELECT work, category, count(*) AS n FROM f GROUP BY work, category""")
def lint_findings(spark, sf_dir):
    """Findings of documents by category: of those categories that plain SQL can say."""
    found = clean.findings(document_lines(spark, sf_dir), ("dupe", "spacing", "struct", "dialog", "headNum", "miscue"))
    return found.groupBy("work", "category").agg(F.count(F.lit(1)).alias("n"))


@query()
def lint_summary(spark, sf_dir):
    """All categories, a row per document."""
    return clean.summary(document_lines(spark, sf_dir))


@query()
def autofix(spark, sf_dir):
    fixed = clean.autofix(document_lines(spark, sf_dir))
    return fixed.select("work", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha256"))


@query(f"""WITH tb AS ({ORACLES['typed_blocks']}), ec AS ({ORACLES['first_speech'].split(', n AS')[0]}, {_NEXT}
  SELECT work, count(*) AS n FROM n WHERE tr LIKE '@%' AND (nx IS NULL OR regexp_matches(nx, '^[@#]')) GROUP BY work), x AS (WITH {_script()}, {_T}
  SELECT work, CAST(sum((tr LIKE '@%')::INT) AS BIGINT) AS cues, CAST(sum((tr LIKE '#%')::INT) AS BIGINT) AS scenes FROM t GROUP BY work),
d AS (SELECT work, count(*) AS long_dialogue FROM tb WHERE type = 'dialogue' AND length(text) > 600 GROUP BY work),
r AS (SELECT x.work, cues, scenes, coalesce(coalesce(n, 0) / nullif(cues, 0), 0.0) AS empty_ratio, coalesce(long_dialogue, 0) AS long_dialogue FROM x LEFT JOIN ec USING (work) LEFT JOIN d USING (work))
SELECT *, CASE WHEN empty_ratio > 0.08 OR scenes = 0 OR cues = 0 THEN 'bad' WHEN empty_ratio > 0.03 OR long_dialogue > 0 THEN 'warn' ELSE 'pass' END AS level FROM r""")
def source_verification(spark, sf_dir):
    return quality.verification(script_lines(spark, sf_dir))


@query()
def scene_warnings(spark, sf_dir):
    return quality.scene_warnings(turn_scenes(spark, sf_dir), scripts(spark, sf_dir))


@query(rf"""WITH tb AS ({ORACLES['typed_blocks']}), sx AS (WITH {_script()} SELECT work, text FROM s_l),
g AS (SELECT work, floor(len(regexp_extract_all(text, '[^\x09\x0A\x0D\x20-\x7E가-힣\x{{A0}}-\x{{24F}}\x{{2010}}-\x{{2027}}\x{{2030}}-\x{{205E}}]')) / greatest(length(text), 1) * 1000 + 0.5) / 10 AS garbage_pct FROM sx),
n AS (SELECT *, {_words('text')} AS w FROM tb), a AS (SELECT work, CAST(sum((type = 'action')::INT) AS BIGINT) AS actions, sum(CASE WHEN type = 'action' THEN w END) AS aw, sum((type = 'action' AND w > 60)::INT) AS la,
  CAST(sum((type = 'dialogue')::INT) AS BIGINT) AS dialogues, sum((type = 'dialogue' AND w > 50)::INT) AS ld FROM n GROUP BY work),
r AS (SELECT work, actions, CAST(floor(coalesce(aw / nullif(actions, 0), 0) + 0.5) AS BIGINT) AS avg_action_words, CAST(floor(coalesce(la / nullif(actions, 0), 0) * 100 + 0.5) AS BIGINT) AS long_action_pct, dialogues,
  CAST(floor(coalesce(ld / nullif(dialogues, 0), 0) * 100 + 0.5) AS BIGINT) AS long_dialogue_pct, garbage_pct FROM a JOIN g USING (work))
SELECT *, CASE WHEN garbage_pct > 1.5 THEN 'C' WHEN avg_action_words > 45 OR long_action_pct > 30 OR long_dialogue_pct > 25 THEN 'A' ELSE 'B' END AS cls FROM r""")
def work_classes(spark, sf_dir):
    return quality.text_classes(script_lines(spark, sf_dir), scripts(spark, sf_dir))


@query(rf"""WITH m AS ({ORACLES['quality_metrics']}), k AS (WITH {_script()} SELECT work, sum(len(regexp_extract_all(text, '(?i)\b(sings?|singing|song)\b')) + len(regexp_extract_all(text, '노래(를|한다|해|하)'))) AS songs,
  sum(len(regexp_extract_all(text, '(?i)\[(크레딧|credit|super|삽입)'))) AS credits FROM l GROUP BY work),
p AS (SELECT CASE WHEN noise_ratio > 0.01 OR broken_cue_ratio > 0.03 THEN 'scan' ELSE 'digital' END AS source, CASE WHEN dialogue_ratio >= 0.65 THEN 'dialogue' WHEN dialogue_ratio <= 0.45 THEN 'description' ELSE 'mixed' END AS weight,
  songs >= 4 AS sung, credits >= 8 AS credited FROM m JOIN k USING (work)),
v AS (SELECT 'source' AS property, source AS value FROM p UNION ALL SELECT 'weight', weight FROM p UNION ALL SELECT 'flag', 'songs' FROM p WHERE sung UNION ALL SELECT 'flag', 'credits' FROM p WHERE credited)
SELECT property, value, count(*) AS works FROM v GROUP BY 1, 2""")
def library_distribution(spark, sf_dir):
    return quality.distribution(quality.profile(quality.metrics(script_lines(spark, sf_dir))))


# --- selection and status ---------------------------------------------------------------------------------------------------


@query(f"""WITH {_DOCS}, n AS (SELECT work, line_no, row_number() OVER (PARTITION BY work ORDER BY line_no) - 1 AS rn, count(*) OVER (PARTITION BY work) AS n FROM l)
SELECT work, line_no FROM n WHERE n <= 7 OR rn IN (SELECT CAST(floor(k * (n / 7.0::DOUBLE)) AS BIGINT) FROM range(0, 7) AS r(k))""")
def systematic_sample(spark, sf_dir):
    """Seven lines of each document, evenly spread."""
    return selection.systematic_sample(document_lines(spark, sf_dir), 7, "line_no").select("work", "line_no")


@query(f"""WITH {_DOCS}, n AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY line_no) - 1 AS rn FROM l),
s AS (SELECT *, sum(length(text)) OVER (PARTITION BY work ORDER BY rn) AS total FROM n WHERE rn % 2 = 0) SELECT work, line_no FROM s WHERE total <= 1000""")
def budget_sample(spark, sf_dir):
    """Every second line of each document, until 1,000 characters."""
    return selection.budget_sample(document_lines(spark, sf_dir), F.length("text"), 1000, 2, "line_no").select("work", "line_no")


@query(r"""WITH w AS (SELECT lang, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL)
SELECT lang, word, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rn FROM c) WHERE rn <= 25""")
def top_words(spark, sf_dir):
    """The 25 most frequent words of each language: a report."""
    tokens = L.words(table(spark, sf_dir, "documents"), "lang", "text", "[A-Za-z]+").withColumnRenamed("work", "lang")
    return selection.top(tokens.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), 25, F.desc("n"), "word", by="lang")


@query(r"""SELECT page_id, CAST(length(t) AS BIGINT) AS chars, md5(t) AS digest FROM (SELECT page_id,
regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s{2,}', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM pages)""")
def html_strip(spark, sf_dir):
    text = clean.strip_markup(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", text.alias("t")).select("page_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("digest"))


@query("SELECT user_id, count(*) AS total, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS done, CAST(sum(CASE WHEN event_type LIKE 'error%' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM events GROUP BY user_id")
def status_rollup(spark, sf_dir):
    """Events of a user as states of a job: a purchase is the end of one."""
    rows = table(spark, sf_dir, "events").withColumn("status", F.when(F.col("event_type") == "purchase", "done").otherwise(F.col("event_type")))
    return selection.status_rollup(rows, "user_id", F.col("status"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark, sf_dir):
    return selection.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts"), "user_id", F.col("ts"), F.col("event_id")).drop("ts")


@query("""SELECT user_id, CAST(sum(us) AS BIGINT) / 1000000 AS active_seconds FROM (SELECT user_id, event_type, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS us FROM events)
WHERE event_type = 'click' AND us IS NOT NULL GROUP BY user_id""")
def active_time(spark, sf_dir):
    return selection.active_time(table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "click", "event_id")


#: What a failed call may say; events are dealt these messages in turn.
MESSAGES = ("", "claude_not_found", "Please login first", "Failed to fetch", "ECONNREFUSED 127.0.0.1", "bad null byte", "Too many requests", "request timed out", "Unexpected token in JSON", "payload too large", "spawn ENOENT", "author unknown")
_MESSAGE = "[" + ", ".join(f"'{m}'" for m in MESSAGES) + f"][event_id % {len(MESSAGES)} + 1]"
_CLASSES = " ".join(f"WHEN regexp_matches(lower(m), '{pattern}') THEN '{name}'" for name, pattern in ERRORS)


@query(f"""SELECT CASE WHEN coalesce(m, '') = '' THEN 'unknown' {_CLASSES} ELSE 'other' END AS class,
count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT event_id, {_MESSAGE} AS m FROM events) GROUP BY 1""")
def error_class_groups(spark, sf_dir):
    """Events by the kind of failure that a message tells of."""
    message = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % len(MESSAGES) + 1).cast("int"))
    return selection.error_groups(table(spark, sf_dir, "events"), message, "event_id")


@query("""SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN value < 10 THEN 1 ELSE 0 END) AS BIGINT) AS failures, sum(CASE WHEN value < 10 THEN 1 ELSE 0 END) >= greatest(2.0, count(*) * 0.5) AS outage FROM events GROUP BY event_type""")
def outage(spark, sf_dir):
    return selection.outage(table(spark, sf_dir, "events"), "event_type", F.col("value") < 10)


@query("SELECT doc_id, CAST(floor(length(text) / 3.0::DOUBLE + 0.5) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


# --- what SQL cannot say ----------------------------------------------------------------------------------------------------


@query()
def collapse_repeats(spark, sf_dir):
    """Runs of repeated phrases folded; back-references are outside the oracle's engine."""
    return table(spark, sf_dir, "documents").select("doc_id", F.length(T.collapse_repeats(F.col("text"))).alias("chars"))


@query()
def lcs_alignment(spark, sf_dir):
    """Blocks of even and odd turns aligned by their types."""
    return align.align_markers(L.typed_blocks(script_lines(spark, sf_dir, "turn % 2 = 0")), L.typed_blocks(script_lines(spark, sf_dir, "turn % 2 = 1")))


def turn_narration(spark, sf_dir, rest):
    """The scenes of every second turn, each under a heading of its own, with the characters of their narration."""
    turns = table(spark, sf_dir, "conversations").filter(F.col("turn") % 2 == rest)
    body = F.concat(F.lit("# TURN "), "turn", F.lit("\n"), F.coalesce("text", F.lit("")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", body.alias("body")))), lambda x: x["body"])
    scripts = turns.groupBy(F.col("conv_id").alias("work")).agg(F.array_join(ordered, "\n").alias("text"))
    return align.narration_lengths(L.to_lines(scripts, "work", "text"))


@query()
def length_alignment(spark, sf_dir):
    """Even turns paired with odd turns by how much narration they have; held against the plain recurrence over whole tables."""
    return align.align_lengths(turn_narration(spark, sf_dir, 0), turn_narration(spark, sf_dir, 1))


@query()
def unpaired_scenes(spark, sf_dir):
    """Even and odd turns that no turn of the other side goes with, with their headings."""
    a, b = turn_narration(spark, sf_dir, 0), turn_narration(spark, sf_dir, 1)
    headings = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b"))).select("work", "side", F.col("scene_no").alias("place"), "heading")
    return align.unpaired(align.align_lengths(a, b), a, b).join(headings, ["work", "side", "place"])


@query(r"""WITH RECURSIVE b AS (SELECT conv_id AS work, turn AS scene_no, len(string_split(coalesce(text, ''), chr(10))) AS lines, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
r AS (SELECT work, scene_no, rn, 0 AS batch, CASE WHEN lines <= 25 THEN 1 ELSE 0 END AS n, CASE WHEN lines <= 25 THEN lines ELSE 0 END AS held FROM b WHERE rn = 1
UNION ALL SELECT b.work, b.scene_no, b.rn, CASE WHEN b.lines <= 25 AND r.n BETWEEN 1 AND 2 AND r.held + b.lines <= 60 THEN r.batch ELSE r.batch + 1 END,
  CASE WHEN b.lines > 25 THEN 0 WHEN r.n BETWEEN 1 AND 2 AND r.held + b.lines <= 60 THEN r.n + 1 ELSE 1 END,
  CASE WHEN b.lines > 25 THEN 0 WHEN r.n BETWEEN 1 AND 2 AND r.held + b.lines <= 60 THEN r.held + b.lines ELSE b.lines END FROM r JOIN b ON b.work = r.work AND b.rn = r.rn + 1)
SELECT work, scene_no, batch FROM r""")
def batch_pack(spark, sf_dir):
    sized = turn_scenes(spark, sf_dir).select("work", "scene_no", F.size(F.split("scene", "\n")).alias("lines"), F.lit(True).alias("heading"))
    return align.pack(sized)


@query("""WITH RECURSIVE l AS (SELECT doc_id AS work, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block_no, length(unnest(string_split(text, chr(10)))) AS sz FROM documents),
r AS (SELECT work, block_no, 0 AS chunk, sz AS size FROM l WHERE block_no = 0 UNION ALL SELECT l.work, l.block_no, CASE WHEN r.size > 0 AND r.size + l.sz >= 2000 THEN r.chunk + 1 ELSE r.chunk END,
  CASE WHEN r.size > 0 AND r.size + l.sz >= 2000 THEN l.sz ELSE r.size + l.sz END FROM r JOIN l ON l.work = r.work AND l.block_no = r.block_no + 1)
SELECT work, CAST(block_no AS BIGINT) AS block_no, chunk FROM r""")
def size_chunks(spark, sf_dir):
    rows = document_lines(spark, sf_dir).withColumnRenamed("line_no", "block_no")
    return align.chunk_by_size(rows, 2000)


@query()
def reading_accuracy(spark, sf_dir):
    """Each turn read against the next, word by word."""
    from pyspark.sql.window import Window as W

    rows = turn_scenes(spark, sf_dir).withColumn("reading", F.lead("scene").over(W.partitionBy("work").orderBy("scene_no")))
    return align.reading_accuracy(rows.filter("reading IS NOT NULL").select("work", F.col("scene").alias("reference"), "reading"))


@query("""SELECT event_type, event_id, rank FROM (SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS INT) AS rank FROM events) WHERE rank <= 50""")
def latest_events(spark, sf_dir):
    """The last fifty events of each type: a log's window, whatever share of the log a type has."""
    rows = table(spark, sf_dir, "events").select("event_type", "ts", "event_id")
    return selection.latest_n(rows, 50, ["event_type"], F.desc("ts"), F.desc("event_id")).select("event_type", "event_id", "rank")


@query()
def reuse_plan(spark, sf_dir):
    """Turns that could be reused: the next turns are taken for their previous results."""
    scenes = turn_scenes(spark, sf_dir)
    previous = scenes.select("work", (F.col("scene_no") - 1).alias("scene_no"), F.col("scene").alias("translated"))
    return incremental.plan_work(scenes, previous).select("work", "scene_no", "reusable")


from . import screen_queries  # noqa: E402, F401  (registers the queries over rendered scripts)

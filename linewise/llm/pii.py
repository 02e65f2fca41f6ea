"""Personal data: fixed patterns, and terms that the corpus shows to give a protected entity away.

The patterns find e-mail addresses, IPv4 addresses, card and phone numbers. Each value found is a protected entity. A term
discloses an entity to the degree that it carries the entity's information: with probabilities estimated from the whole
corpus, PMI(term, entity) / IC(entity), which is 1 for a term that is seen only with the entity. A term that exceeds the disclosure threshold is
generalised to a class of terms whose own disclosure, measured in the same way, does not exceed it: the terms with the same first three, two or
one characters. Where no class is common enough, it is removed.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty, written

KINDS = ("email", "ip", "card", "phone")
ADDED = "term"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")
_TERM = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    doubled = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(doubled[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def email_spans(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ outwards: in linear time, however long the runs of letters are."""
    spans, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        free = found.end() if found else max(free, at + 1)
        if found:
            spans.append((start, found.end()))
        at = text.find("@", free)
    return spans


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind; those that fail the kind's test are dropped, and their text is not tried again."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    found["email"] = email_spans(text) if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


def entity_key(kind: str, value: str) -> int:
    """The same key however an address is capitalised or a number is spaced."""
    plain = value.lower() if kind == "email" else value if kind == "ip" else _NOT_DIGIT.sub("", value)
    return xxhash.xxh3_64_intdigest(f"{kind}:{plain}".encode()) - (1 << 63)


def terms_of(text: str) -> list[tuple[str, int, int]]:
    """The (lower-case term, start, end) of a text in order."""
    return [(m[0].lower(), *m.span()) for m in _TERM.finditer(text)]


def nearby_terms(terms: list[tuple[str, int, int]], span: tuple[int, int], words: int) -> list[tuple[str, int, int]]:
    """The `words` terms of a text before and after a span, numbers aside; terms that the span cuts are neither."""
    before, after = bisect.bisect_right(terms, span[0], key=lambda t: t[2]), bisect.bisect_left(terms, span[1], key=lambda t: t[1])
    return [t for t in terms[max(0, before - words) : before] + terms[after : after + words] if not t[0].isdigit()]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate((*KINDS, ADDED))}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def disclosing_terms(docs: DataFrame, text_col: str = "text", words: int = 8, support: int = 3, threshold: float = 0.75) -> DataFrame:
    """(entity, term, disclosure, instead): terms whose nearness gives an entity away, from counts over all texts, and the class that may stand for each.

    Contexts are the windows of `words` terms on each side of an entity; equal contexts, as in copies of a text, count once, so
    that copying a text proves nothing. A term needs `support` different contexts of the entity. Its disclosure is
    PMI / IC = 1 + ln p(entity | term) / IC(entity), where p(entity | term) is the number of those contexts over the number of different
    texts with the term anywhere, and IC(entity) = ln(texts / texts with the entity). The disclosure of a class is that of a term that stands wherever
    one of its terms does; `instead` is the narrowest class below the threshold, or null.
    """
    texts = docs.select(text_or_empty(text_col).alias("text"))

    def contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[tuple[int, str, int, int]] = []
            for text in batch.column("text").to_pylist():
                base = [(kind, a, b) for kind, spans in base_spans(text).items() for a, b in spans]
                if not base:
                    continue
                terms, doc = terms_of(text), xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
                for kind, a, b in base:
                    near = [t for t, _, _ in nearby_terms(terms, (a, b), words)]
                    seen = xxhash.xxh3_64_intdigest("\n".join(near).encode("utf-8", "surrogatepass")) - (1 << 63)
                    out += [(entity_key(kind, text[a:b]), t, seen, doc) for t in set(near)]
            yield pa.RecordBatch.from_pydict({"entity": [r[0] for r in out], "term": pa.array([r[1] for r in out], pa.string()), "context": [r[2] for r in out], "doc": [r[3] for r in out]}, schema=pa.schema([("entity", pa.int64()), ("term", pa.string()), ("context", pa.int64()), ("doc", pa.int64())]))

    seen = written(texts.mapInArrow(contexts, "entity long, term string, context long, doc long").distinct(), "pii-contexts")
    together = lambda rows: rows.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("together"))
    pairs = written(together(seen).filter(F.col("together") >= support), "pii-pairs")
    of_entity = seen.select("entity", "doc").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("entity_docs"))
    # a class takes part in the counts as one more term, for the entities of the pairs with one of its terms
    prefixes = F.array_compact(F.array(*[F.when(F.length("term") > k, F.concat(F.substring("term", 1, k), F.lit("*"))) for k in (3, 2, 1)]))
    classes = pairs.select("entity", F.explode(prefixes).alias("term")).distinct()
    of_classes = together(seen.select("entity", F.explode(prefixes).alias("term"), "context").join(classes, ["entity", "term"]))
    pairs = written(pairs.unionByName(of_classes).join(of_entity, "entity"), "pii-counted")

    terms = written(pairs.select("term").distinct(), "pii-wanted")
    few = sendable(terms, F.octet_length("term") + 64)
    wanted = None if few is None else docs.sparkSession.sparkContext.broadcast(frozenset(r.term for r in few))

    def occurring(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text in batch.column("text").to_pylist():
                found = set(_TERM.findall(text.lower()))
                found |= {t[:k] + "*" for t in found for k in (1, 2, 3) if len(t) > k}
                out.append("\n".join(found if wanted is None else found & wanted.value))
            yield pa.RecordBatch.from_arrays([batch.column("of_text"), pa.array(out, pa.string())], names=["of_text", "terms"])

    # copies of a text meet by its hash, as a row of the wanted terms in it: the text itself stays where it is
    different = texts.withColumn("of_text", F.xxhash64("text")).mapInArrow(occurring, "of_text long, terms string").dropDuplicates(["of_text"])
    different = written(different, "pii-texts")
    term_docs = different.filter("terms <> ''").select(F.explode(F.split("terms", "\n")).alias("term"))
    if wanted is None:
        term_docs = term_docs.join(terms, "term", "left_semi")
    term_docs = term_docs.groupBy("term").agg(F.count(F.lit(1)).alias("term_docs"))
    n = max(1, different.count())
    information = F.log(F.lit(float(n)) / F.col("entity_docs"))
    shown = F.least(F.lit(1.0), F.col("together") / F.col("term_docs"))
    scored = pairs.join(term_docs, "term").withColumn("disclosure", F.lit(1.0) + F.log(shown) / F.greatest(information, F.lit(1e-9)))
    scored = written(scored.select("entity", "term", "disclosure"), "pii-scored")
    flagged = scored.filter((F.col("disclosure") >= threshold) & ~F.col("term").endswith("*"))
    wide = flagged.select("entity", F.col("term").alias("of_term"), F.explode(prefixes).alias("term")).join(scored.filter(F.col("disclosure") < threshold).select("entity", "term"), ["entity", "term"])
    wide = wide.groupBy("entity", F.col("of_term").alias("term")).agg(F.max_by("term", F.length("term")).alias("instead"))
    return flagged.join(wide, ["entity", "term"], "left").select("entity", "term", "disclosure", "instead")


def sendable(rows: DataFrame, size: Column, most: int = 16 << 20) -> list | None:
    """The rows, if they have no more than `most` bytes by the size of a row, else None; rows must be cheap to read."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    return rows.collect() if total <= most else None


def find_pii(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 8, support: int = 3, threshold: float = 0.75, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of docs: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, clean_text, and the columns in `carry`.

    spans lists kind:start:end of all spans by kind, then start (code points, end exclusive); base_sha256 is the digest of that list
    without the added kind `term`. A term is marked wherever it stands outside base spans in a text that holds the entity
    it discloses. In clean_text a base span is replaced by its kind in brackets, a term by the class it is generalised to,
    as `[zol*]`, or by nothing where it has none; of several entities of a text the one that asks for the widest class decides.

    Defined cases: a null text is empty: no spans. No rows give no rows. Copies of a text neither add nor
    remove terms. Work on a text is linear in its length.
    """
    flagged = written(disclosing_terms(docs, text_col, words, support, threshold), "pii-terms")
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    few = sendable(flagged, F.octet_length("term") + 160)
    if few is not None:
        by_entity: dict[int, list[tuple[str, str | None]]] = {}
        for r in few:
            by_entity.setdefault(r.entity, []).append((r.term, r.instead))
        known = docs.sparkSession.sparkContext.broadcast(by_entity)  # 16 MB at most
        rows = rows.withColumn("own", F.lit(None).cast("array<struct<entity:bigint,term:string,instead:string>>"))
    else:  # too many to send to every task: each text gets those of its own entities by a join
        known = None
        rows = rows.withColumn("row_key", F.xxhash64("id", "text"))

        def entities(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                out = [(k, entity_key(kind, t[a:b])) for k, t in zip(batch.column("row_key").to_pylist(), batch.column("text").to_pylist(), strict=True) for kind, spans in base_spans(t).items() for a, b in spans]
                yield pa.RecordBatch.from_pydict({"row_key": pa.array([r[0] for r in out], pa.int64()), "entity": pa.array([r[1] for r in out], pa.int64())})

        own = rows.select("row_key", "text").mapInArrow(entities, "row_key long, entity long").distinct().join(flagged, "entity")
        own = own.groupBy("row_key").agg(F.collect_list(F.struct("entity", "term", "instead")).alias("own"))
        rows = rows.join(own, "row_key", "left").drop("row_key")

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: dict[str, list] = {k: [] for k in (*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_term", "clean_text")}
            for text, own in zip(batch.column("text").to_pylist(), batch.column("own").to_pylist(), strict=True):
                found = base_spans(text)
                base = [(k, a, b) for k, spans in found.items() for a, b in spans]
                asked = [(r["term"], r["instead"]) for r in own or ()]
                for kind, a, b in base if known else ():
                    asked += known.value.get(entity_key(kind, text[a:b]), ())
                terms: dict[str, str] = {}
                for term, instead in asked:
                    terms[term] = min(terms.get(term, term), instead or "", key=len)
                added = []
                if terms:
                    covered, at = [], 0
                    for a, b in sorted((a, b) for _, a, b in base):  # spans of different kinds can overlap: merge them
                        if covered and a < covered[-1][1]:
                            covered[-1] = (covered[-1][0], max(b, covered[-1][1]))
                        else:
                            covered.append((a, b))
                    for m in _TERM.finditer(text):
                        while at < len(covered) and covered[at][1] <= m.start():
                            at += 1
                        if m[0].lower() in terms and not (at < len(covered) and covered[at][0] < m.end()):
                            added.append((ADDED, *m.span()))
                for kind in KINDS:
                    out[f"n_{kind}"].append(len(found[kind]))
                out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out["spans"].append(_joined(base + added))
                out["n_term"].append(len(added))
                parts, at = [], 0
                for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
                    if a >= at:
                        instead = kind.upper() if kind != ADDED else terms[text[a:b].lower()]
                        parts += [text[at:a], f"[{instead}]" if instead else ""]
                    at = max(at, b)
                out["clean_text"].append("".join([*parts, text[at:]]))
            kept = {"id": batch.column("id")} | {f"carried_{c}": batch.column(f"carried_{c}") for c in carry}
            new = {k: pa.array(v, pa.string() if k in ("base_sha256", "spans", "clean_text") else pa.int64()) for k, v in out.items()}
            yield pa.RecordBatch.from_arrays([*kept.values(), *new.values()], names=[*kept, *new])

    types = {"id": docs.schema[id_col].dataType.simpleString()} | {f"carried_{c}": docs.schema[c].dataType.simpleString() for c in carry}
    types |= {f"n_{k}": "bigint" for k in KINDS} | {"base_sha256": "string", "spans": "string", "n_term": "bigint", "clean_text": "string"}
    marked = rows.mapInArrow(mark, ", ".join(f"`{k}` {v}" for k, v in types.items()))
    return marked.select(F.col("id").alias(id_col), *[F.col(f"carried_{c}").alias(c) for c in carry], *[c for c in types if c != "id" and not c.startswith("carried_")])

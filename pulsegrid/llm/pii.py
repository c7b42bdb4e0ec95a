"""Information-theoretic sanitisation of personal data.

Base detectors find e-mail addresses, IP addresses, payment cards and phone numbers. Over the whole corpus the
words near each entity, and near the part of it that others share (the domain of an address, the first three
numbers of an IP), are counted with it, and these words are counted everywhere. A word t discloses an entity c as
far as it tells of it: PMI(t, c) / IC(c) = log(p(c | t) / p(c)) / -log p(c), which is 1 if c is never away where t
is. Words that reach ``DISCLOSURE`` are removed too, so that rare entities count as well as common ones.

Chance and copies aside: a word needs ``SUPPORT`` occurrences near the entity that differ on both sides, measured
as the perplexity of the words before it and of those after it, so that copies of one passage count about once.
All counts are partial aggregates over word codes.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm import textcodes as tc
from pulsegrid.llm.common import bitmap, in_bitmap, text_batches, with_columns_from_batches, written

KINDS = ("email", "ip", "card", "phone", "term")
#: Words on each side of an entity that count as near it.
NEAR = 8
#: Perplexity of the words on either side of a word near an entity.
SUPPORT = 3.0
#: Share of what an entity's mention tells from which a word discloses it.
DISCLOSURE = 0.95
#: No smaller share of a word's occurrences reaches ``DISCLOSURE`` in a corpus of up to 10^14 words.
LEAST_SHARE = 0.2
#: Disclosing words that are broadcast (8 bytes each); more are joined to their texts.
BROADCAST_WORDS = 1_000_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match ends at the end of a run of digits, so that one can only begin at the beginning of a run.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, in one walk from each @ to the left and right."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Spans by kind as listed, then start, in code points."""
    if not _ANY.search(text):
        return []
    out = [("email", s, e) for s, e in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _code(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.lower().encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _parts(kind: str, entity: str) -> list[int]:
    """Codes of an entity and of the part of it that others share."""
    shared = {"email": entity[entity.rfind("@") :], "ip": entity[: entity.rfind(".") + 1]}.get(kind)
    return [_code(entity), _code(shared)] if shared else [_code(entity)]


def _near(text: str, spans: list[Span]) -> list[tuple[int, str, str, str]]:
    """(entity code, word, word before it, word after it) of the ``NEAR`` whole words on each side of an entity, words
    in entities, short ones and numbers aside; and the same with the code 0 once for each of these words."""
    taken = sorted((s, e) for _, s, e in spans)
    words, k, reach = [], 0, 0
    for m in _WORD.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            reach = max(reach, taken[k][1])
            k += 1
        if m.start() >= reach:
            words.append(m)
    start = [m.start() for m in words]
    out, any_ = [], set()
    for kind, s, e in spans:
        at = bisect_left(start, s)
        for code in _parts(kind, text[s:e]):
            for w in range(max(0, at - NEAR), min(len(words), at + NEAR)):
                word = words[w][0]
                if len(word) > 2 and not word.isdigit():
                    any_.add(w)
                    out.append((code, word, words[w - 1][0] if w else "", words[w + 1][0] if w + 1 < len(words) else ""))
    return out + [(0, words[w][0], "", "") for w in sorted(any_)]


#: The words of ``textcodes.ALNUM``.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def word_codes(words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.int64)
    raw = [w.encode("utf-8", "replace") for w in words]
    end = np.cumsum([len(r) for r in raw])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    return tc.codes(buf, np.concatenate(([0], end[:-1])), end).view(np.int64)


def _mentions(slim: DataFrame) -> DataFrame:
    """Per entity and word near it: joint (occurrences) and support (the least perplexity of its neighbours). The
    entity 0 stands for any."""

    def near(batches):
        for batch in batches:
            rows = []
            for body in batch.column(0).to_pylist():
                if body and (spans := base_spans(body)):
                    rows += _near(body, spans)
            entity = np.array([r[0] for r in rows], np.int64)
            word, before, after = (word_codes([r[k] for r in rows]) for k in (1, 2, 3))
            two = np.concatenate((np.arange(len(rows)), np.flatnonzero(entity)))
            side = np.concatenate((np.zeros(len(rows), np.int8), np.ones(len(two) - len(rows), np.int8)))
            other = np.concatenate((before, after[entity != 0]))
            yield pa.RecordBatch.from_arrays([pa.array(entity[two]), pa.array(word[two]), pa.array(side), pa.array(other)], names=["entity", "word", "side", "other"])

    seen = slim.mapInArrow(near, "entity long, word long, side byte, other long").groupBy("entity", "word", "side", "other").agg(F.count("*").alias("n"))
    of = lambda side, x: F.coalesce(F.sum(F.when(F.col("side") == side, x)), F.lit(0.0))
    spread = F.col("n") * F.log("n")
    counts = seen.groupBy("entity", "word").agg(of(0, F.col("n").cast("double")).alias("joint"), of(0, spread).alias("before"), of(1, spread).alias("after"))
    return counts.select("entity", "word", "joint", (F.col("joint") * F.exp(-F.greatest("before", "after") / F.col("joint"))).alias("support"))


def _occurrences(slim: DataFrame, words: DataFrame) -> DataFrame:
    """(word, alone): occurrences of the words, and of a few others that a bitmap can't tell from them; word 0: of all."""
    wanted = bitmap(words, "word")

    def count(batches):
        word, n, total = [], [], 0
        for batch in batches:
            for _, _, buf, at in tc.chunks(batch.column(0)):
                code = tc.text_words(buf, at, tc.ALNUM)[0].view(np.int64)
                total += len(code)
                got = np.unique(code[in_bitmap(wanted.value, code)], return_counts=True) if len(code) else (code, code)
                word.append(got[0])
                n.append(got[1])
            if sum(map(len, word)) > 1 << 20:
                yield summed(word, n)
                word, n = [], []
        yield summed([*word, np.zeros(1, np.int64)], [*n, np.array([total])])

    def summed(word, n):
        at, back = np.unique(np.concatenate(word), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.bincount(back, np.concatenate(n)).astype(np.int64))], names=["word", "n"])

    return slim.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").cast("double").alias("alone"))


def disclosing_words(docs: DataFrame, text: str = "text", support: float = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """Codes of words that disclose an entity, with the largest measure, over all texts."""
    slim = docs.select(F.col(text).alias("text"))
    text_batches(docs.sparkSession)
    joint = written(_mentions(slim), "near")
    anywhere = joint.where("entity = 0").select("word", F.col("joint").alias("beside"))
    telling = joint.where((F.col("entity") != 0) & (F.col("support") >= support - 1e-9)).join(anywhere, "word")
    # a word is at least as often in the corpus as near entities
    telling = written(telling.where(F.col("joint") >= LEAST_SHARE * F.col("beside")).select("entity", "word", "joint"), "telling")
    mentions = joint.where("entity <> 0").join(telling.select("entity").distinct(), "entity", "left_semi").groupBy("entity").agg(F.sum("joint").alias("of_entity"))
    alone = written(_occurrences(slim, telling), "alone")
    total = F.lit(float(max(2.0, alone.where("word = 0").agg(F.max("alone")).first()[0] or 0)))
    measured = telling.join(alone, "word").join(mentions, "entity")
    prior = F.least(F.col("of_entity") / total, F.lit(1.0) - 1e-12)
    words = measured.select("word", (F.log(F.col("joint") / F.col("alone") / prior) / -F.log(prior)).alias("measure"))
    return written(words.where(F.col("measure") >= disclosure).groupBy("word").agg(F.max("measure").alias("measure")), "disclosing")


def find_spans(docs: DataFrame, text: str = "text", broadcast_words: int = BROADCAST_WORDS, **options) -> DataFrame:
    """``docs`` with ``base`` and ``found``: arrays of (kind, start, end), ``found`` holding the words that
    disclose an entity as well. Spans are in code points, end exclusive; null and empty texts have none; very long
    ones are read whole; an empty table gives no rows; repeated rows each get their spans; columns named base or
    found are replaced."""
    shape = lambda x: [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans] for spans in x]
    fields = [T.StructField(c, T.ArrayType(SPAN)) for c in ("base", "found")]
    return _over_spans(docs, text, broadcast_words, options, lambda _, base, found: [shape(base), shape(found)], fields)


def _over_spans(docs: DataFrame, text: str, broadcast_words: int, options: dict, make, fields: list) -> DataFrame:
    """``docs`` with the columns ``fields`` that ``make`` gives from a batch's texts, base spans and all spans."""
    words = disclosing_words(docs, text, **options)
    if words.count() <= broadcast_words:
        few = np.sort(np.array([r[0] for r in words.select("word").collect()], np.int64))
        return _spans(docs, text, docs.sparkSession.sparkContext.broadcast(few), None, make, fields)
    coded = with_columns_from_batches(docs, _text_code(text), [T.StructField("__of", T.LongType())])
    held = _held(docs.select(F.col(text).alias("text")), words).join(words, "word")
    per_text = held.groupBy("of").agg(F.sort_array(F.collect_set("word")).alias("__words")).withColumnRenamed("of", "__of")
    return _spans(coded.join(per_text, "__of", "left").drop("__of"), text, None, "__words", make, fields).drop("__words")


def _held(slim: DataFrame, words: DataFrame) -> DataFrame:
    """(of, word): the texts, as codes, that hold words which a bitmap takes for the given ones."""
    wanted = bitmap(words, "word")

    def places(batches):
        for batch in batches:
            for _, _, buf, at in tc.chunks(batch.column(0)):
                whole = tc.codes(buf, at, np.append(at[1:], len(buf)) - 1)
                word, first = tc.text_words(buf, at, tc.ALNUM)
                hit = np.flatnonzero(in_bitmap(wanted.value, word.view(np.int64))) if len(word) else np.zeros(0, np.int64)
                of = np.searchsorted(first, hit, "right") - 1
                got = np.unique(np.stack([whole[of], word[hit]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, k].copy().view(np.int64)) for k in (0, 1)], names=["of", "word"])

    return slim.mapInArrow(places, "of long, word long").distinct()


def _text_code(text: str):
    def make(batches):
        for batch in batches:
            code = np.zeros(batch.num_rows, np.uint64)
            for lo, hi, buf, at in tc.chunks(batch.column(batch.schema.get_field_index(text))):
                code[lo:hi] = tc.codes(buf, at, np.append(at[1:], len(buf)) - 1)
            yield batch, [code.view(np.int64)]

    return make


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def _spans(docs: DataFrame, text: str, shared, column: str | None, made, fields: list) -> DataFrame:
    def make(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            own = batch.column(batch.schema.get_field_index(column)).to_pylist() if column else None
            base = [base_spans(t) if t else [] for t in texts.to_pylist()]
            found = [list(b) for b in base]
            for lo, _, buf, at in tc.chunks(texts):
                start, end = tc.words(buf, tc.ALNUM)
                code = tc.codes(buf, start, end).view(np.int64)
                first = np.concatenate((np.searchsorted(start, at), [len(start)]))
                if own is None and len(shared.value):
                    known = shared.value[np.minimum(np.searchsorted(shared.value, code), len(shared.value) - 1)] == code
                elif own is None:
                    continue
                else:
                    known = np.zeros(len(code), bool)
                    for i in range(len(at)):
                        if own[lo + i]:
                            known[first[i] : first[i + 1]] = np.isin(code[first[i] : first[i + 1]], own[lo + i])
                for w in np.flatnonzero(known):
                    i = int(np.searchsorted(first, w, "right")) - 1
                    s = len(buf[at[i] : start[w]].tobytes().decode("utf-8", "replace"))
                    e = s + len(buf[start[w] : end[w]].tobytes().decode("utf-8", "replace"))
                    if not any(a < e and s < b for _, a, b in base[lo + i]):
                        found[lo + i].append(("term", s, e))
            yield batch, made(texts, base, found)

    return with_columns_from_batches(docs, make, fields)


def _text(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def span_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = find_spans(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    counts = [_count("base", k).alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(_text("base"), 256).alias("base_sha256"), _text("found").alias("spans"))


def generalised(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; one that begins inside another goes with it."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, text: str = "text", broadcast_words: int = BROADCAST_WORDS, **options) -> DataFrame:
    """``docs`` with each span of ``text`` generalised to its kind in brackets, and ``n_chars``, if there, anew.
    Null texts stay null; every row and every other column stays as it is, whatever its name."""

    def made(texts, _, found):
        return [[generalised(t, f) if t and f else t for t, f in zip(texts.to_pylist(), found, strict=True)]]

    out = _over_spans(docs, text, broadcast_words, options, made, [T.StructField(text, T.StringType())])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

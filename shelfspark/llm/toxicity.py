"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text and normalised by length.

Folding makes look-alikes equal: case, accents and compatibility forms go, letters of other alphabets that look Latin become
Latin, digits and signs that stand for letters become these (1, l and i are one letter), and characters of no width vanish.
Whatever isn't a letter then separates words.

The lexicon is learned: a term is a word, or the first letters of words, that is in significantly more toxic documents than
by chance (G-test of document counts); its weight is its log odds ratio. Where several terms match at one word, the
strongest counts. Exception phrases are given, or learned: two words with a term in them, or a longer word that starts with
one, that don't tell toxic documents, and among the documents with that term are significantly more often in clean ones. A term within an exception doesn't count,
neither in a text nor, once the exceptions are known, for its weight. A document's density is the sum of its weights for each word, with
LENGTH words added; the score is a logistic curve over the density's logarithm and over whether there is a match at all. The curve is fitted with each document
left out of its own terms' counts, since a rare word of one toxic document would prove itself otherwise.

Terms are counted by Spark over a bounded sample of labelled rows (ROWS of each class); scoring is a narrow map over all rows.

Edge cases: a null text counts as empty, and an empty text has no match and gets the score of such texts; labels that are
null or belong to no document are left out, repeated labels and documents count repeatedly; without labels the score is 0.5
for all, with a single class near that class's share. Other columns pass through; those with the name of a result are
replaced. Fit and score read the text alone.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import fold, materialise, small_batches

#: Labelled rows of each class that are learned from, at most: those whose ids hash lowest.
ROWS = 20_000
#: Learned from: rows outside this fold.
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: First letters of words that can be a term.
STEMS = range(4, 11)
#: Terms of the lexicon, the strongest by evidence; least evidence (about one in 10,000 by chance).
TERMS, EVIDENCE = 20_000, 15.0
#: Least log odds ratio of a candidate, and of a term once exceptions don't count any more (about one to seven). On held-out
#: rows 3 and 4 lose documents whose terms are also the start of ordinary words.
CANDIDATE, WEIGHT = 0.7, 2.0
#: Learned exception phrases, and the clean documents that one needs.
PHRASES, PHRASE_DOCUMENTS = 5_000, 3
#: Words added to each document's length; density of 1 hit of weight 1 in so many words is 1.
LENGTH, PER = 20, 10_000
#: Steps of the density's logarithm in the fit of the curve.
STEPS = 16

#: Letters that look like Latin ones, and digits and signs that stand for letters.
LOOK_ALIKES = dict(zip("аеорсухкмтвніјѕԁһԛԝɡαβεικνορτυχıł", "aeopcyxkmtbhijsdhqwgabeiknoptuxil", strict=True))
DIGITS = dict(zip("013456789", "oieasgtbg", strict=True))
SIGNS = dict(zip("@$!|", "asii", strict=True))
#: Phrases in which a term is no insult.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum")

_signs = re.compile(r"[@$!|](?=\w)")
HITS = T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())]))


class _Letters(dict):
    """What each character becomes; filled as characters are met."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code)).casefold():
            c = DIGITS.get(c, LOOK_ALIKES.get(c, c))
            if unicodedata.category(c) in ("Mn", "Me", "Cf"):
                continue
            out += "i" if c == "l" else c if c.isalpha() else " "
        self[code] = out
        return out


_letters = _Letters()


def folded(text: str | None) -> list[str]:
    """The words of a text in folded letters."""
    text = text or ""
    if any(s in text for s in SIGNS):
        text = _signs.sub(lambda m: SIGNS[m[0]], text)
    return text.translate(_letters).split()


def evidence(t, c, p, n, log=math.log):
    """G-test statistic of a term in t of p toxic and c of n clean documents, half a document added to each cell."""
    cells = [(t + 0.5, c + 0.5), (p - t + 0.5, n - c + 0.5)]
    whole = p + n + 2.0
    return 2.0 * sum(x * log(x * whole / ((a + b) * total)) for a, b in cells for x, total in ((a, p + 1.0), (b, n + 1.0)))


def weight(t, c, p, n, log=math.log):
    """Log odds ratio of the term's document frequencies."""
    return log((t + 0.5) * (n + 1.0) / ((c + 0.5) * (p + 1.0)))


@dataclass
class Lexicon:
    """Document counts (toxic, clean) of each term; of phrases, the exceptions; the curve: log odds without a match, what any
    match adds, and what the density's logarithm adds."""

    terms: dict[str, tuple[int, int]] = field(default_factory=dict)
    toxic: int = 0
    clean: int = 0
    phrases: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    least: float = WEIGHT

    def strength(self, term: str, label: int | None = None) -> float:
        """The term's weight, 0 if it doesn't count; for a document with this label, without that document."""
        t, c = self.terms[term]
        p, n = self.toxic, self.clean
        if label == 1:
            t, p = t - 1, p - 1
        elif label == 0:
            c, n = c - 1, n - 1
        if t <= 0 or c < 0 or min(p, n) < 1:
            return 0.0
        found = weight(t, c, p, n)
        return found if found >= self.least and evidence(t, c, p, n) >= EVIDENCE else 0.0


class Matcher:
    """Aho-Corasick automaton over the terms and phrases of a lexicon. Terms start with the space before a word, and those that
    are whole words end with the space behind it; so a match's start tells its word."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for term in lexicon.terms:
            self.automaton.add_word(term, (term, False))
        for phrase in lexicon.phrases:
            self.automaton.add_word(f" {phrase} ", (f" {phrase} ", True))
        #: Where a phrase's words start, in its characters.
        self.starts = {f" {p} ": [i for i, c in enumerate(f" {p}") if c == " "] for p in lexicon.phrases}
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()
        self.strengths: dict[tuple[str, int | None], float] = {}

    def strength(self, term: str, label: int | None) -> float:
        key = (term, label)
        if key not in self.strengths:
            self.strengths[key] = self.lexicon.strength(term, label)
        return self.strengths[key]

    def matches(self, words: list[str]) -> list[tuple[int, str]]:
        """Terms outside of exceptions, with the place of the space before the word."""
        if self.empty or not words:
            return []
        spared, found = set(), []
        for end, (term, exempt) in self.automaton.iter(f" {' '.join(words)} "):
            start = end - len(term) + 1
            if exempt:
                spared.update(start + i for i in self.starts[term])
            else:
                found.append((start, term))
        return [x for x in found if x[0] not in spared] if spared else found

    def hits(self, words: list[str], label: int | None = None) -> dict[int, tuple[str, float]]:
        """Of each word (by number) with a term that counts, the strongest one and its weight."""
        best: dict[int, tuple[str, float]] = {}
        for start, term in self.matches(words):
            if (found := self.strength(term, label)) > best.get(start, ("", 0.0))[1]:
                best[start] = (term, found)
        if not best:
            return {}
        line, place, at, out = f" {' '.join(words)}", 0, 0, {}
        for start in sorted(best):
            place += line.count(" ", at, start)
            at = start
            out[place] = best[start]
        return out

    def level(self, words: list[str], hits: dict[int, tuple[str, float]]) -> float:
        """Logarithm of the density."""
        return math.log1p(PER * sum(w for _, w in hits.values()) / (len(words) + LENGTH))


def terms_of(words: list[str]) -> set[str]:
    """What a document counts for: its words, and their first letters."""
    out = set()
    for w in set(words):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in STEMS if k <= len(w))
    return out


def _counted(sample: DataFrame, of) -> DataFrame:
    """Documents by term and class: toxic and clean, of what `of` returns for a text and its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (Counter(), Counter())

        def emit() -> pa.RecordBatch:
            names = list(each[0] | each[1])
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([each[k][x] for x in names], pa.int64()) for k in (1, 0)]], names=["term", "toxic", "clean"])

        for batch in batches:
            for label, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                each[label].update(of(body, label))
                if len(each[0]) + len(each[1]) > 500_000:
                    yield emit()
                    each = (Counter(), Counter())
        yield emit()

    parts = small_batches(sample).select("label", "body").mapInArrow(run, "term string, toxic long, clean long")
    return parts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _fit_curve(levels: Iterable[tuple[float, int, float]]) -> tuple[float, float, float]:
    """Logistic curve over (level, label, weight) by Newton's method with shortened steps; a small ridge keeps it finite where
    classes separate."""
    x, y, w = (np.array(v, dtype=np.float64) for v in zip(*levels, strict=True))
    features, b, ridge = np.stack((np.ones_like(x), x > 0, x), axis=1), np.zeros(3), np.full(3, 1e-3)

    def loss(b: np.ndarray) -> float:
        odds = features @ b
        return float((w * (np.logaddexp(0, odds) - y * odds)).sum() + (ridge * b * b).sum() / 2)

    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(features @ b, -500, 500)))
        gradient = features.T @ (w * (p - y)) + ridge * b
        step = np.linalg.solve((features * (w * p * (1 - p))[:, None]).T @ features + np.diag(ridge), gradient)
        size = 1.0
        while size > 1e-9 and loss(b - size * step) > loss(b):
            size /= 2
        b = b - size * step
        if size * np.abs(step).max() < 1e-9:
            break
    return tuple(b.tolist())


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", rows: int = ROWS, exceptions: Iterable[str] = EXCEPTIONS, least: float = WEIGHT) -> Lexicon:
    """Learn the lexicon from at most `rows` labelled documents of each class, outside the held-out fold. Only ids of that
    bounded sample are broadcast, and the driver gets the lexicon's terms and phrases, whose number is bounded, alone."""
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter((fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    shares = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    picked = [usable.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    texts = documents.select("doc_id", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
    sample = materialise(texts.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").select("label", "body"))
    held = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    lexicon = Lexicon(toxic=held.get(1, 0), clean=held.get(0, 0), phrases=tuple(" ".join(folded(e)) for e in exceptions), least=least)
    if not held:
        return lexicon
    if len(held) == 2:
        lexicon.terms = _terms(sample, lexicon)
        lexicon.phrases += _phrases(sample, replace(lexicon, least=CANDIDATE))
        lexicon.terms = _recounted(sample, lexicon)
    share = [shares.get(k, 0) / max(1, min(shares.get(k, 0), rows)) for k in (0, 1)]
    lexicon.curve = _fit_curve([(r["step"] / STEPS, r["label"], share[r["label"]] * r["n"]) for r in sorted(_levels(sample, lexicon).collect())])
    return lexicon


def _terms(sample: DataFrame, lexicon: Lexicon) -> dict[str, tuple[int, int]]:
    """The strongest terms. Those that would count without one of their clean documents come too, for the curve's fit."""
    p, n = float(lexicon.toxic), float(lexicon.clean)
    clean = F.greatest(F.col("clean") - 1, F.lit(0))
    counted = _counted(sample, lambda body, label: terms_of(folded(body))).filter("toxic > 1")
    strong = counted.withColumn("evidence", evidence(F.col("toxic"), clean, p, n, F.log)).filter((weight(F.col("toxic"), clean, p, n, F.log) >= CANDIDATE) & (F.col("evidence") >= EVIDENCE))
    return {r["term"]: (r["toxic"], r["clean"]) for r in strong.orderBy(F.desc("evidence"), "term").limit(TERMS).collect()}


def _phrases(sample: DataFrame, lexicon: Lexicon) -> tuple[str, ...]:
    """Two words with a term in them, or a longer word that starts with one, that clean documents hold more often than the
    term, and that don't tell toxic ones."""
    held: list[Matcher] = []

    def near(body: str, label: int) -> set[str]:
        if not held:
            held.append(Matcher(lexicon))
        words, out = folded(body), set()
        for at, (term, _) in held[0].hits(words).items():
            out.update(f"{' '.join(words[i : i + 2])}\t{term}" for i in (at - 1, at) if 0 <= i < len(words) - 1)
            if not term.endswith(" "):
                out.add(f"{words[at]}\t{term}")
        return out

    p, n = float(lexicon.toxic), float(lexicon.clean)
    counted = _counted(sample, near).filter(F.col("clean") >= PHRASE_DOCUMENTS)
    tells = (weight(F.col("toxic"), F.col("clean"), p, n, F.log) > 0) & (evidence(F.col("toxic"), F.col("clean"), p, n, F.log) >= EVIDENCE)
    found = set()
    for r in counted.filter(~tells).orderBy(F.desc("clean"), "term").limit(PHRASES).collect():
        phrase, term = r["term"].split("\t")
        toxic, clean = lexicon.terms[term]
        if weight(r["clean"], r["toxic"], clean, toxic) > 0 and evidence(r["clean"], r["toxic"], clean, toxic) >= EVIDENCE:
            found.add(phrase)
    return tuple(sorted(found))


def _recounted(sample: DataFrame, lexicon: Lexicon) -> dict[str, tuple[int, int]]:
    """The lexicon's terms with their documents outside of exceptions."""
    held: list[Matcher] = []

    def outside(body: str, label: int) -> set[str]:
        if not held:
            held.append(Matcher(lexicon))
        return {term for _, term in held[0].matches(folded(body))}

    return {r["term"]: (r["toxic"], r["clean"]) for r in _counted(sample, outside).collect()}


def _levels(sample: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Documents by class and step of the density's logarithm, each left out of its terms' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, found = Matcher(lexicon), Counter()
        for batch in batches:
            for label, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = folded(body)
                found[label, round(STEPS * matcher.level(words, matcher.hits(words, label)))] += 1
        columns = [[k[0] for k in found], [k[1] for k in found], list(found.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["label", "step", "n"])

    return small_batches(sample).mapInArrow(run, "label long, step long, n long").groupBy("label", "step").agg(F.sum("n").alias("n"))


def classify(df: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "score", hits: str = "hits") -> DataFrame:
    """Add `out` (double, 0 to 1) for the whole text of each row, and `hits`: number of the word, folded term and weight."""
    keep = [c for c in small_batches(df).columns if c not in (out, hits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, (base, match, slope) = Matcher(lexicon), lexicon.curve
        for batch in batches:
            scores, each = [], []
            for body in batch.column(batch.num_columns - 1).to_pylist():
                words = folded(body)
                found = matcher.hits(words)
                odds = base + match * bool(found) + slope * matcher.level(words, found)
                scores.append(1 / (1 + math.exp(min(500.0, -odds))))
                each.append([{"word": i, "term": t.strip(), "weight": w} for i, (t, w) in found.items()])
            kind = pa.list_(pa.struct([("word", pa.int64()), ("term", pa.string()), ("weight", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(scores, pa.float64()), pa.array(each, kind)], names=[*keep, out, hits])

    rows = df.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType()), T.StructField(hits, HITS)])
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)

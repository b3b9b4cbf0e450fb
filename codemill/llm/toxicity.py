"""Problem 10: abusive, hateful or sexual content.

Method: a linear-chain conditional random field tags offending tokens. It is trained on the sentences with labelled tokens of
toxicity_examples.py and on rated documents (doc_labels): the tokens of documents rated clean are clean, and the spans of
documents rated toxic are those that the field itself finds there, in turns of tagging and training. Forward-backward gives
the probability of every token; a sentence's probability mass over its tokens makes spans, and the document's score is that
of its worst span. Scoring reads whole texts of all documents.

The training sample is bounded by SAMPLE documents per rating, taken in order of a hash; the field is a few arrays of fixed
size (WORDS, PAIRS) and is broadcast.

Before anything is looked up, a token is folded: case, accents, look-alike letters, invisible characters, letters set apart,
repeated letters and digits in place of letters. A token with masked letters (id##t) is the known offending word that fits.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codemill.llm.toxicity_examples import CLEAN, MARKED

#: Documents of each rating (toxic, clean) that train the field at most.
SAMPLE = 1500
#: Documents without a rating that train the field at most: their sentences count little, and only where the field sees no offence.
UNRATED = 600
#: Sentences of clean documents that train the field at most, after equal ones count once.
CLEAN_SENTENCES = 30_000
#: Size of the hashed tables of word pairs.
PAIRS = 1 << 17
#: Score above which a document counts as a case, and a token as part of a span.
THRESHOLD = 0.5
STOP, UNKNOWN, IDENT, NUMBER, MASKED = range(5)
_SPECIAL = 5

INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
APART = re.compile(r"(?<![^\s(\"'])[^\W\d_](?: [^\W\d_]){3,}(?![^\s.,;:!?)\"'])")
_LIKE = str.maketrans("абвеёзікмнорстухјѕԁɡαεικνορτυχ", "abveezikmhopctyxjsdgaeikvoptux")
_DIGITS = str.maketrans("01345789@$!|", "oieastbgasii")
_LETTER_L = str.maketrans("01345789@$!|", "oleastbgasil")
_EDGES = " \t\x01.,;:!?\"'`´()[]{}<>«»“”„‘’‚‹›¡¿~^|=+/\\&%-–—…"
_PLAIN = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_TECHNICAL = re.compile(r"[_/\\=<>{}()\[\]]|[A-Za-z]\.[A-Za-z]|::")
_REPEAT = re.compile(r"(.)\1+")
_MASK = re.compile(r"[a-z]+(?:([*#\-_.$@%&?])\1*[a-z]*)+")
_IDENT = re.compile(r"[_/\\=<>{}()\[\]]|[a-z][A-Z]|\w\.\w|::")


def folded(raw: str) -> tuple[str, bool]:
    """The token without the punctuation around it, '' for none, and whether a sentence ends with it."""
    ends = raw[-1] in ".!?:;" or raw[-1] in ")\"'»”" and len(raw) > 1 and raw[-2] in ".!?"
    return raw.strip(_EDGES), ends


def letters(word: str) -> str:
    """Lower case without accents and look-alikes, repeated letters once."""
    low = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", word).lower())
    low = "".join(c for c in low if not unicodedata.combining(c)).replace("ß", "ss").translate(_LIKE)
    return _REPEAT.sub(r"\1", low)


class Lexicon(dict):
    """Token -> id * 2 + (a sentence ends here). Words of training have ids of their own; others are classes by shape."""

    def __init__(self, words: dict[str, int], offending: list[str]) -> None:
        super().__init__()
        self.words = words
        self.by_length: dict[int, list[str]] = {}
        for w in offending:
            self.by_length.setdefault(len(w), []).append(w)

    def __missing__(self, raw: str) -> int:
        if len(self) > 400_000:
            self.clear()
        word, ends = folded(raw)
        value = self[raw] = self.code(word) * 2 + ends
        return value

    def code(self, word: str) -> int:
        if not word:
            return STOP
        if word.isascii():
            if _PLAIN.fullmatch(word):
                return self.words.get(_REPEAT.sub(r"\1", word.lower()), UNKNOWN)
            if _TECHNICAL.search(word):
                return IDENT
        plain = letters(word)
        known = self.words.get(plain)
        if known is not None:
            return known
        if word.isalpha():
            return UNKNOWN if word.islower() or word.istitle() or word.isupper() else IDENT
        if word.isdigit():
            return NUMBER
        if len(word) <= 24:
            low = unicodedata.normalize("NFKC", word).lower().translate(_LIKE)
            for table in (_DIGITS, _LETTER_L):
                if any(c.isalpha() for c in low):
                    known = self.words.get(letters(low.translate(table)))
                    if known is not None:
                        return known
            if _MASK.fullmatch(low):
                pattern = re.compile("".join(c if c.isalpha() else "." for c in low))
                for w in self.by_length.get(len(low), ()):
                    if pattern.fullmatch(w):
                        return self.words[_REPEAT.sub(r"\1", w)]
                if re.search(r"[a-z](?:[*#]{1,}|[-.]{2,})[a-z]*$", low):
                    return MASKED
        if any(c.isdigit() for c in word) and not any(c.isalpha() for c in word):
            return NUMBER
        if "-" in word or "'" in word or "’" in word:
            return self.words.get(letters(word.replace("’", "'")), UNKNOWN if not _IDENT.search(word) else IDENT)
        return IDENT


def tokens(text: str) -> list[str]:
    text = INVISIBLE.sub("", text)
    if APART.search(text):
        text = APART.sub(lambda m: m[0].replace(" ", ""), text)
    return text.replace("\n", " \x01 ").split()


def encode(text: str, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the tokens, and where sentences end."""
    got = np.fromiter(map(lexicon.__getitem__, tokens(text)), np.int64)
    return got >> 1, (got & 1).astype(bool) | (got >> 1 == STOP)


def sentences(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of the sentence of each token."""
    return np.r_[0, np.cumsum(ends)[:-1]] if len(ids) else np.empty(0, np.int64)


class Field:
    """A chain over the labels clean and offending. Weights belong to the label offending: of the word, of the word before and
    after (own tables), of the pairs with them (hashed); trans are the usual four, and start."""

    def __init__(self, size: int) -> None:
        self.word, self.before, self.after = np.zeros(size), np.zeros(size), np.zeros(size)
        self.pair_before, self.pair_after = np.zeros(PAIRS), np.zeros(PAIRS)
        self.bias = np.array([-2.0, 0.0, -2.0, 1.0])  # of the label, start, clean to offending, offending to offending

    def features(self, x: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Indices into the five tables for a flat run of tokens; first marks the tokens that begin a chain."""
        before = np.where(first, STOP, np.roll(x, 1))
        after = np.where(np.roll(first, -1), STOP, np.roll(x, -1))
        return [x, before, after, (before * 1_000_003 + x * 7919) % PAIRS, (x * 1_000_003 + after * 7919 + 17) % PAIRS]

    def tables(self) -> list[np.ndarray]:
        return [self.word, self.before, self.after, self.pair_before, self.pair_after]

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        f = self.features(x, first)
        out = self.bias[0] + self.word[f[0]]
        for table, at in zip(self.tables()[1:], f[1:]):
            out += table[at]
        return out + self.bias[1] * first


def forward_backward(e: np.ndarray, starts: np.ndarray, sizes: np.ndarray, to: float, stay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, ahead, behind) of each token of many chains. p: probability of the label offending; ahead: forward odds of it;
    behind: its own and its backward odds. e: its score against clean; to and stay: score of going from clean to offending
    and of staying there (0 otherwise). All chains of a step are taken at once."""
    out, behind = np.empty(len(e)), np.empty(len(e))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(longest), side="left")  # chains that have a token at step t
    p_to, p_stay = np.exp(to), np.exp(stay)
    odds = np.exp(np.clip(e, -30, 30))
    a = np.empty(len(e))
    prev = np.empty(0)
    for t in range(longest):
        at = starts[: live[t]] + t
        prev = odds[at] if t == 0 else odds[at] * (p_to + p_stay * prev[: live[t]]) / (1 + prev[: live[t]])
        a[at] = prev
    b = np.ones(len(starts))
    for t in range(longest - 1, -1, -1):
        at = starts[: live[t]] + t
        if t + 1 < longest:
            n = live[t + 1]
            nxt = odds[starts[:n] + t + 1] * b[:n]
            b[:n] = (1 + p_stay * nxt) / (1 + p_to * nxt)
        r = a[at] * b[: live[t]]
        out[at] = r / (1 + r)
        behind[at] = odds[at] * b[: live[t]]
    return out, a, behind


def train(x: list[np.ndarray], y: list[np.ndarray], size: int, weight: list[float], rounds: int = 40, field: Field | None = None) -> Field:
    """Gradient steps with a rate of each weight's own (as of Adagrad) on the likelihood of the labels."""
    field = field or Field(size)
    sizes = np.array([len(v) for v in x])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    flat, labels = np.concatenate(x), np.concatenate(y).astype(float)
    first = np.zeros(len(flat), bool)
    first[starts] = True
    w = np.repeat(np.array(weight), sizes)
    f = field.features(flat, first)
    tables = field.tables()
    sums = [np.full(len(t), 1e-2) for t in tables]
    bias_sum = np.full(4, 1e-2)
    follows = np.flatnonzero(~first)
    for _ in range(rounds):
        e = field.scores(flat, first)
        p, ahead, behind = forward_backward(e, starts, sizes, field.bias[2], field.bias[3])
        g = (p - labels) * w
        left, right = ahead[follows - 1], behind[follows]
        into, both = np.exp(field.bias[2]) * right, left * np.exp(field.bias[3]) * right
        whole = 1 + left + into + both
        into, both = into / whole, both / whole
        seen_both, seen_into = labels[follows] * labels[follows - 1], labels[follows] * (1 - labels[follows - 1])
        grad = np.array([g.sum(), (g * first).sum(), ((into - seen_into) * w[follows]).sum(), ((both - seen_both) * w[follows]).sum()])
        bias_sum += grad**2
        field.bias -= 0.05 * grad / np.sqrt(bias_sum)
        field.bias = np.clip(field.bias, -6, 3)
        for table, at, s, rate in zip(tables, f, sums, (0.3, 0.15, 0.15, 0.2, 0.2)):
            d = np.bincount(at, g, len(table)) + 0.02 * table
            s += d * d
            table -= rate * d / np.sqrt(s)
    return field


def _examples() -> list[tuple[str, int, bool]]:
    """(token, label, a sentence ends before it) of the labelled sentences."""
    rows = []
    for block in (MARKED, CLEAN):
        for line in block.strip().splitlines():
            on, first = 0, True
            for raw in line.replace("[", " [ ").replace("]", " ] ").split():
                if raw in "[]":
                    on = int(raw == "[")
                    continue
                rows.append((raw, on, first))
                first = False
    return rows


class Model:
    def __init__(self, words: dict[str, int], offending: list[str], field: Field) -> None:
        self.words, self.offending, self.field = words, offending, field

    def lexicon(self) -> Lexicon:
        return Lexicon(self.words, self.offending)


def fit(rated: list[tuple[str, int | None]]) -> Model:
    """rated: (text, 0, 1 or None for not rated) of some documents. Without any, the labelled sentences alone train the field."""
    rows = _examples()
    groups: list[list[tuple[str, int]]] = []
    for raw, on, first in rows:
        if first:
            groups.append([])
        groups[-1].append((raw, on))
    seen: Counter = Counter()
    pieces: list[tuple[list[str], int]] = []  # 2: not rated
    for text, toxic in rated:
        run: list[str] = []
        for raw in [*tokens(text), "\x01"]:
            word, ends = folded(raw)
            if word:
                run.append(raw)
            if (ends or not word) and run:
                pieces.append((run, 2 if toxic is None else toxic))
                run = []
    marked_words = {letters(folded(raw)[0]) for raw, _, _ in rows} - {""}
    for run, _ in pieces:
        seen.update({letters(folded(raw)[0]) for raw in run if raw.isascii() is False or not _IDENT.search(raw)})
    vocabulary = sorted(marked_words | {w for w, n in seen.items() if n >= 2 and w and not any(c.isdigit() for c in w)})
    words = {w: i + _SPECIAL for i, w in enumerate(vocabulary)}
    clean_words = {letters(folded(raw)[0]) for group in groups for raw, on in group if not on}
    offending = sorted({unicodedata.normalize("NFKD", folded(raw)[0].lower()).encode("ascii", "ignore").decode() for group in groups for raw, on in group if on} - {""})
    offending = [w for w in offending if len(w) >= 4 and _REPEAT.sub(r"\1", w) not in clean_words and _REPEAT.sub(r"\1", w) in words]
    lexicon = Lexicon(words, offending)
    size = len(words) + _SPECIAL
    x = [np.array([lexicon[raw] >> 1 for raw, _ in g]) for g in groups]
    y = [np.array([on for _, on in g]) for g in groups]
    base = train(x, y, size, [1.0] * len(x), 60)
    if not pieces:
        return Model(words, offending, base)
    found: dict[bytes, list] = {}
    for run, toxic in pieces:
        ids = np.array([lexicon[raw] >> 1 for raw in run])
        entry = found.setdefault(ids.tobytes(), [ids, 0, 0, 0])
        entry[1 + toxic] += 1
    clean = [e for e in found.values() if e[1]][:CLEAN_SENTENCES]
    suspect = [e for e in found.values() if e[2] and not e[1]]
    unrated = [e for e in found.values() if not e[1] and not e[2]][:CLEAN_SENTENCES]
    field = base
    for _ in range(3):
        def tagged(entries: list) -> list[np.ndarray]:
            sizes = np.array([len(e[0]) for e in entries])
            if not len(sizes):
                return []
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            flat = np.concatenate([e[0] for e in entries])
            first = np.zeros(len(flat), bool)
            first[starts] = True
            p = forward_backward(field.scores(flat, first), starts, sizes, field.bias[2], field.bias[3])[0]  # noqa: B023
            return np.split(p, starts[1:])

        more_x, more_y, weight = list(x), list(y), [2.0] * len(x)
        for e, p in zip(clean, tagged(clean)):
            if p.max() < 0.9 or e[1] > 3:  # else the rating is taken as wrong
                more_x.append(e[0])
                more_y.append(np.zeros(len(p), int))
                weight.append(min(3.0, 0.5 + 0.5 * e[1]))
        for e, p in zip(unrated, tagged(unrated)):
            if p.max() < 0.7 or e[3] > 5:
                more_x.append(e[0])
                more_y.append(np.zeros(len(p), int))
                weight.append(0.3 if e[3] < 3 else 1.0)
        for e, p in zip(suspect, tagged(suspect)):
            more_x.append(e[0])
            more_y.append((p > 0.5).astype(int))
            weight.append(1.0 if p.max() > 0.8 or p.max() < 0.2 else 0.2)
        field = train(more_x, more_y, size, weight, 40)
    return Model(words, offending, field)


def _spans(p: np.ndarray, sentence: np.ndarray) -> list[tuple[int, int, float]]:
    """(first token, behind the last, score): runs of tokens above THRESHOLD within a sentence."""
    on = p > THRESHOLD
    out = []
    for i in np.flatnonzero(on & ~(np.r_[False, on[:-1]] & np.r_[False, sentence[1:] == sentence[:-1]])).tolist():
        j = i + 1
        while j < len(p) and on[j] and sentence[j] == sentence[i]:
            j += 1
        out.append((i, j, float(p[i:j].max())))
    return out


def score_texts(texts: list[str | None], model: Model, lexicon: Lexicon) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(score, probabilities, sentences) of each text."""
    coded = [encode(t, lexicon) if t else (np.empty(0, np.int64), np.empty(0, bool)) for t in texts]
    lengths = np.array([len(i) for i, _ in coded])
    if not lengths.sum():
        return [(0.0, np.empty(0), np.empty(0, np.int64)) for _ in texts]
    flat, ends = np.concatenate([i for i, _ in coded]), np.concatenate([e for _, e in coded])
    at = np.r_[0, np.cumsum(lengths)]
    first = np.r_[True, ends[:-1]]
    first[at[:-1][lengths > 0]] = True
    starts = np.flatnonzero(first)
    sizes = np.diff(np.r_[starts, len(flat)])
    p = forward_backward(model.field.scores(flat, first), starts, sizes, model.field.bias[2], model.field.bias[3])[0]
    number = np.cumsum(first)
    top = np.zeros(len(texts))
    has = np.flatnonzero(lengths)
    top[has] = np.maximum.reduceat(p, at[has])
    return [(float(s), p[a:b], number[a:b]) for s, a, b in zip(top, at[:-1], at[1:])]


def _rated(labels: DataFrame, documents: DataFrame) -> list[tuple[str, int | None]]:
    """At most SAMPLE rated documents of each kind and UNRATED others, those whose ratings differ among them."""
    ratings = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi")).where("lo = hi")
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").join(ratings, "doc_id", "left_anti")
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(UNRATED).select("doc_id", F.lit(None).cast("int").alias("hi"))
    for kind in (0, 1):
        ids = ids.union(ratings.where(F.col("hi") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("doc_id", "hi"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    got = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("hi").alias("toxic")).toArrow()
    rows = sorted(zip(*(got.column(c).to_pylist() for c in ("doc_id", "text", "toxic"))), key=lambda r: r[0])
    return [(t, k) for _, t, k in rows]


def offsets(text: str, found: list[str]) -> list[tuple[int, int]]:
    """(start, end) in text of each of its tokens: their characters stand there in order, with others between that do not count."""
    at, out = 0, []
    for token in found:
        start = at
        if token != "\x01":
            start = text.index(token[0], at)
            for c in token:
                at = text.index(c, at) + 1
        out.append((start, at))
    return out


def _located(text: str, p: np.ndarray, sentence: np.ndarray) -> list[dict]:
    places = offsets(text, tokens(text))
    return [{"start": places[i][0], "end": places[j - 1][1], "score": s} for i, j, s in _spans(p, sentence)]


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, source, score (0 to 1), spans (array of start, end, score: characters of the text, the end is not part of it).

    Null, empty and blank texts score 0 and have no spans; every row of documents with a doc_id gives one, repeated ones too;
    other columns are ignored. Without any rated document the labelled sentences and unrated documents train the field."""
    sent = documents.sparkSession.sparkContext.broadcast(fit(_rated(labels, documents)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = sent.value.lexicon()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            got = score_texts(texts, sent.value, lexicon)
            spans = [_located(t, p, n) if score > THRESHOLD else [] for t, (score, p, n) in zip(texts, got)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([g[0] for g in got], pa.float64()), pa.array(spans, kind)], names=["doc_id", "source", "score", "spans"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source")).where("doc_id is not null")
    return rows.mapInArrow(run, "doc_id long, source string, score double, spans array<struct<start: int, end: int, score: double>>")


def toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id of documents that score above THRESHOLD, once each."""
    return scored(documents, labels).where(F.col("score") > THRESHOLD).select("doc_id").distinct()


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """source, documents, toxic, rate: the share of each source's documents that score above THRESHOLD."""
    each = scored(documents, labels).groupBy("source", "doc_id").agg(F.max("score").alias("score"))
    toxic_ = F.sum((F.col("score") > THRESHOLD).cast("long"))
    return each.groupBy("source").agg(F.count("*").alias("documents"), toxic_.alias("toxic"), F.round(toxic_ / F.count("*"), 6).alias("rate"))

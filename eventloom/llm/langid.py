"""Language identification of mixed-language text.

A word is a run of letters. The script of its first letter narrows the languages to
those that use the script; each of these scores the word by the logarithms of its
character trigrams' frequencies (word ends included). The Viterbi algorithm then labels all words
of a text at once: the best sequence of languages, where each switch costs a penalty, so
that single odd words do not break a span. The text's language is the one whose spans
have the most letters, and the score is their share of all letters.

Trigrams are hashed to a fixed number of buckets, so the model's size is that number
times the languages; it is counted over all labelled rows with Spark.

Defined results: a text that is null, empty or has no letter is `und` with score 0, as is
every text if there is nothing to learn from; ties go to the language that sorts first;
very long texts are scored whole, in slices; rows that repeat get a result each; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.shared import release_memory
from eventloom.session import ship_package

UNKNOWN = "und"
BUCKETS = 1 << 16
SWITCH_PENALTY = 8.0
#: Letters are scored in slices of so many code points, and texts labelled together up to so many.
SLICE, PART = 1 << 19, 1 << 20
#: Languages with the most letters in the labelled texts, of which a model is made.
MAX_LANGUAGES = 256
#: Share of a language's letters from which on it uses a script.
SCRIPT_SHARE = 0.01

#: First code points of ranges and the script from there on.
SCRIPT_STARTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(1)
def _script_ranges() -> tuple[np.ndarray, np.ndarray]:
    starts, names = zip(*SCRIPT_STARTS)
    return np.array(starts), np.array([SCRIPTS.index(n) for n in names])


def word_features(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: trigram bucket of each letter and each word's end, first index and script of each word.

    Slices end between words.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    at = 0
    while at < len(points):
        end = min(at + SLICE, len(points))
        while end < len(points) and letter[end]:
            end += 1
        own = letter[at:end]
        here = np.concatenate(([0, 0], np.where(own, points[at:end], 0), [0])).astype(np.uint64)
        at = end
        known = np.concatenate((own, [False]))
        # A trigram ends at each letter and just behind each word.
        ends = known | np.concatenate(([False], own))
        hashed = (here[:-2] * np.uint64(0x9E3779B1) + here[1:-1] * np.uint64(0x85EBCA6B) + here[2:] * np.uint64(0xC2B2AE35)) * np.uint64(0x9E3779B97F4A7C15)
        buckets = (hashed >> np.uint64(48)).astype(np.int64)[ends]
        first = known & ~np.concatenate(([False], known[:-1]))
        starts = (np.cumsum(ends) - 1)[first]
        if len(starts):
            lows, names = _script_ranges()
            yield buckets, starts, names[np.searchsorted(lows, here[2:][first], side="right") - 1]


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict | None:
    """The model of all rows with a text and a language; None if there are none.

    What reaches the driver is one number per language and bucket or script. Where labels are
    so dirty that there are more than `MAX_LANGUAGES`, those with the most letters are learned.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.text, batch.lang):
                own = sums.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                for buckets, starts, scripts in word_features(text):
                    own[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
                    own[BUCKETS:] += np.bincount(scripts, minlength=len(SCRIPTS))
        for lang, own in sums.items():
            some = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "cell": some, "n": own[some]})
        release_memory()

    ship_package(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    largest = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("letters")).orderBy(F.desc("letters"), "lang").limit(MAX_LANGUAGES)
    rows = rows.join(F.broadcast(largest.select("lang")), "lang")
    counts = rows.mapInPandas(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    if not len(counts):
        return None
    langs = sorted(counts.lang.unique())
    table = np.zeros((len(langs), BUCKETS + len(SCRIPTS)))
    table[[langs.index(x) for x in counts.lang], counts.cell] = counts.n
    grams, scripts = table[:, :BUCKETS] + 0.1, table[:, BUCKETS:]
    share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
    uses = share >= SCRIPT_SHARE
    uses[:, ~uses.any(axis=0)] = True
    return {
        "langs": langs,
        "logs": np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32).copy(),
        "uses": uses.T.copy(),
    }


def word_scores(text: str, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(words, languages) scores and the number of letters of each word."""
    scores, letters = [], []
    for buckets, starts, scripts in word_features(text):
        own = np.add.reduceat(model["logs"][buckets], starts, axis=0)
        scores.append(np.where(model["uses"][scripts], own, -1e6))
        letters.append(np.diff(starts, append=len(buckets)) - 1)
    if not scores:
        return np.zeros((0, len(model["langs"])), np.float32), np.zeros(0, np.int64)
    return np.concatenate(scores), np.concatenate(letters)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of all words of many texts, whose scores stand one after the other.

    All texts advance together, longest first, so that those that go on are a prefix.
    """
    labels = np.zeros(len(scores), np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sorted_lengths = lengths[order]
    steps = int(sorted_lengths[0]) if len(lengths) else 0
    going = np.searchsorted(-sorted_lengths, -np.arange(steps), side="left")
    came = np.zeros(scores.shape, np.int16)
    own = np.arange(scores.shape[1])
    best = np.zeros((len(lengths), scores.shape[1]))
    for t in range(steps):
        n = going[t]
        at = starts[:n] + t
        if t:
            top = best[:n].argmax(axis=1)
            switched = (best[np.arange(n), top] - penalty)[:, None]
            stay = best[:n] >= switched
            came[at] = np.where(stay, own, top[:, None])
            best[:n] = np.where(stay, best[:n], switched)
        best[:n] += scores[at]
    last = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        n = going[t]
        at = starts[:n] + t
        labels[at] = last[:n]
        last[:n] = came[at, last[:n]]
    return labels


def _predict(texts: list[str], model: dict, penalty: float) -> pd.DataFrame:
    parts = [word_scores(t, model) for t in texts]
    lengths = np.array([len(p[1]) for p in parts], np.int64)
    letters = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0)
    labels = viterbi(np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, 1)), lengths, penalty)
    text_of = np.repeat(np.arange(len(parts)), lengths)
    n = len(model["langs"])
    total = np.bincount(text_of * n + labels, letters, len(parts) * n).reshape(-1, n)
    top, all_letters = total.argmax(axis=1), total.sum(axis=1)
    return pd.DataFrame(
        {
            "lang_pred": [model["langs"][x] if a else UNKNOWN for x, a in zip(top, all_letters)],
            "score": np.where(all_letters > 0, total.max(axis=1) / np.maximum(all_letters, 1), 0.0),
        }
    )


def language_spans(text: str, model: dict, penalty: float = SWITCH_PENALTY) -> list[tuple[str, int]]:
    """The text's spans in order: language and number of words."""
    scores, _ = word_scores(text, model)
    labels = viterbi(scores, np.array([len(scores)]), penalty)
    cuts = np.flatnonzero(np.diff(labels)) + 1
    return [(model["langs"][part[0]], len(part)) for part in np.split(labels, cuts) if len(part)]


def _in_parts(texts: pd.Series, model: dict, penalty: float) -> pd.DataFrame:
    """`_predict` for a part of the texts at a time, so that a batch of long ones takes no more memory."""
    parts, held, points = [], [], 0
    for text in texts:
        held.append(text or "")
        points += len(held[-1])
        if points >= PART:
            parts.append(_predict(held, model, penalty))
            held, points = [], 0
    return pd.concat([*parts, _predict(held, model, penalty)] if held or not parts else parts, ignore_index=True)


def predict(df: DataFrame, model: dict | None, text_col: str = "text", penalty: float = SWITCH_PENALTY) -> Column:
    """A column of structs: lang_pred and score."""
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def batches(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield _in_parts(batch, shared.value, penalty)
        release_memory()

    return F.pandas_udf(batches, "lang_pred string, score double")(F.col(text_col).cast("string"))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred and score; learned from the rows not held out."""
    model = learn(docs.where(~held_out(id_col)), text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), predict(docs, model, text_col).alias("found"))
    return rows.select("doc_id", "held_out", "found.lang_pred", "found.score")


def drop_unidentified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` in a known language, columns unchanged."""
    model = learn(docs.where(~held_out(id_col)), text_col, lang_col)
    return (
        docs.select(F.struct("*").alias("row"), predict(docs, model, text_col).alias("found"))
        .where(F.col("found.lang_pred") != UNKNOWN)
        .select("row.*")
    )

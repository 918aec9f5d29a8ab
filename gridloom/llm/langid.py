"""Language identification by cross-parsing entropy.

A suffix automaton is built for each language from labelled text. A text is cut from left to right into phrases, each
the longest match in the language's automaton; phrases x log2(automaton's text length) estimates the cross entropy, and
the language that needs the fewest normalised phrases wins.

Every text is parsed whole, from its first character to its last: the texts of an Arrow batch and all languages in step,
one table look-up a character, and the few longest texts to their ends one by one. A language's commonest letters have
columns in its table; the look-ups of its other letters are exact too, by search in a sorted list of transitions.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROW, staged, with_rows

#: Bounds of the labelled sample: rows a language, and the characters at which its automaton is full. All tables
#: together take TABLE_BYTES at most: with more than about 15 languages each gets fewer characters.
ROWS, CHARS, TABLE_BYTES = 60, 24_000, 192 << 20
#: Letters of a language that have columns of their own in its table.
DENSE = 94
#: Below so many texts still unfinished, each is parsed to its end alone.
FEW = 16
UNKNOWN = "und"
_letters = threading.local()


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not hasattr(_letters, "table"):
        _letters.table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters.table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def squeeze(codes: np.ndarray) -> np.ndarray:
    """Codes with each run of zeros as one."""
    return codes[np.concatenate(([True], (codes[1:] | codes[:-1]) != 0))] if codes.size else codes


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton that accepts the substrings of codes; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


@dataclass
class Automaton:
    """One language. table[state * width + column] is (next state * width * 4) + (phrases that this character ends).

    Column 0 is what is no letter, 1 is letters that no language has; the others are `columns` by letter number. rare
    holds state * letters + letter, sorted, of the transitions by other letters, whose targets are in `to`.
    """

    columns: np.ndarray  # by letter number; -1: a rare letter of this language; 1: none of its letters
    table: np.ndarray
    width: int
    rare: np.ndarray
    to: np.ndarray
    bits: float  # log2 of the sample's length

    def steps(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states (as row starts) and phrases ended, for states and letter numbers."""
        column = self.columns.take(letter)
        e = self.table.take(state + np.abs(column))
        if self.rare.size and (own := np.flatnonzero(column < 0)).size:
            e[own] = self.by_search(state[own], letter[own])
        return e >> 2, e & 3

    def by_search(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        n = len(self.columns)

        def find(s):
            key = s // self.width * n + letter
            at = np.minimum(np.searchsorted(self.rare, key), len(self.rare) - 1)
            return self.rare[at] == key, self.to[at].astype(np.int64) * self.width * 4

        here, to = find(state.astype(np.int64))
        _, again = find(np.zeros(len(state), np.int64))  # every letter of the language leads somewhere from the root
        return np.where(here, to, again + 1)


@dataclass
class Model:
    languages: list[str]
    letters: dict[int, int]  # code point to letter number; 0: no letter, 1: a letter of no language
    automata: list[Automaton]

    def encoder(self) -> np.ndarray:
        out = letters().astype(np.int32)
        for point, number in self.letters.items():
            out[point] = number
        return out

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (letter numbers) in each language."""
        out = np.zeros((len(self.languages), len(texts)), np.int64)
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        if not order.size:
            return out
        flat, size = np.concatenate([texts[i] for i in order.tolist()]), size[order]
        first = np.cumsum(size) - size
        steps = int(size[FEW]) if len(size) > FEW else 0
        active = np.searchsorted(-size, -np.arange(steps), side="left")
        state = [np.zeros(len(order), a.table.dtype) for a in self.automata]
        count = np.ones((len(self.automata), len(order)), np.int64)
        for t, n in enumerate(active.tolist()):
            letter = flat.take(first[:n] + t)
            for k, automaton in enumerate(self.automata):
                state[k][:n], ended = automaton.steps(state[k][:n], letter)
                count[k, :n] += ended
        for lane in range(min(FEW, len(order))):
            rest = flat[first[lane] + steps : first[lane] + size[lane]]
            for k, automaton in enumerate(self.automata):
                count[k, lane] += self.alone(automaton, int(state[k][lane]), rest)
        out[:, order] = count
        return out

    @staticmethod
    def alone(automaton: Automaton, state: int, text: np.ndarray) -> int:
        """Phrases that the rest of one text ends."""
        ended, table = 0, memoryview(automaton.table)
        for at in range(0, len(text), 1 << 16):
            part = text[at : at + (1 << 16)]
            for column, letter in zip(automaton.columns.take(part).tolist(), part.tolist()):
                if column < 0:
                    e = int(automaton.by_search(np.array([state]), np.array([letter]))[0])
                else:
                    e = table[state + column]
                ended += e & 3
                state = e >> 2
        return ended

    def predict(self, texts: list[str | None], encoder: np.ndarray) -> list[tuple[str, float]]:
        """Language and score of each text. score: second lowest entropy over the sum of the two lowest, 0.5 to 1.

        Of equal entropies the language that comes first in the order of names wins.
        """
        codes = [squeeze(encoder[code_points(t)]) if t else np.empty(0, np.int32) for t in texts]
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        entropy = self.phrases(codes) * np.array([a.bits for a in self.automata])[:, None]
        best = entropy.argmin(0)
        if len(self.languages) > 1:
            low = np.partition(entropy, 1, axis=0)[:2]
            score = low[1] / np.maximum(low.sum(0), 1e-12)
        else:
            score = np.ones(len(texts))
        return [(self.languages[b], float(s)) if c.any() else (UNKNOWN, 0.0) for b, s, c in zip(best.tolist(), score.tolist(), codes)]


def automaton(codes: np.ndarray, letters: int) -> Automaton:
    """The automaton of a sample in letter numbers below `letters`."""
    seen = np.bincount(codes, minlength=letters)
    seen[:2] = 0
    common = [c for c in np.argsort(-seen, kind="stable")[:DENSE].tolist() if seen[c]]
    columns = np.where(seen > 0, -1, 1).astype(np.int32)
    columns[0] = 0
    columns[common] = np.arange(len(common)) + 2
    width, step = len(common) + 2, suffix_automaton(codes.tolist())
    table = np.full((len(step), width), -1, np.int64)
    rare, to = [], []
    for s, targets in enumerate(step):
        for c, target in targets.items():
            if columns[c] >= 0:
                table[s, columns[c]] = target
            else:
                rare.append(s * letters + c)
                to.append(target)
    ends = table < 0
    root = np.maximum(table[0], 0)  # a letter that the language lacks is a phrase of its own
    table = np.where(ends, root[None, :], table)
    ended = ends.astype(np.int8)
    ended[1:, root == 0] *= 2
    kind = np.int32 if len(step) * width * 4 < 2**31 else np.int64
    order = np.argsort(np.array(rare, np.int64), kind="stable")
    return Automaton(columns, (table * (width * 4) + ended).ravel().astype(kind), width, np.array(rare, np.int64)[order], np.array(to, np.int32)[order], float(np.log2(max(2, len(codes)))))


def build(samples: dict[str, list[str]], chars: int = CHARS) -> Model:
    """Automata of the texts of each language, added until there are `chars` characters of them; the last one is cut."""
    chars = max(1, min(chars, TABLE_BYTES // (max(1, len(samples)) * 2 * 4 * (DENSE + 2))))
    points, has = {}, letters()
    for language, texts in sorted(samples.items()):
        kept, total = [], 0
        for t in texts:
            p = code_points(t)[: max(0, chars - total)]
            if has[p].any():
                kept.append(p)
                total += len(p)
        if kept:
            points[language] = kept
    known = np.unique(np.concatenate([p for kept in points.values() for p in kept])) if points else np.empty(0, np.uint32)
    model = Model(sorted(points), {p: i + 2 for i, p in enumerate(known[has[known]].tolist())}, [])
    encoder = model.encoder()
    for language in model.languages:
        codes = squeeze(np.concatenate([np.append(encoder[p], 0) for p in points[language]]))
        model.automata.append(automaton(codes, len(model.letters) + 2))
    return model


def train(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = ROWS, chars: int = CHARS) -> Model:
    """Learn from the rows that `usable` admits and whose lang is not null.

    For each language at most `rows` rows that aren't empty, those of least xxhash64(key) (of equal ones, the first by
    place), go to the driver, and of each at most its first `chars` characters: a bounded, documented sample, in which
    a language whose texts are all long is learned too. Keys may repeat or be null.
    """
    own = with_rows(docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"), usable.alias("usable")))
    ids = own.where(F.col("usable") & F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", ROW, F.xxhash64("key").alias("h"))
    ids = ids.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("h", ROW))).where(F.col("rank") <= rows)
    picked = own.select(ROW, F.substring("text", 1, chars).alias("text")).join(F.broadcast(staged(ids, "sample")), ROW)  # `rows` a language
    samples: dict[str, list[str]] = {}
    for r in picked.select("lang", "rank", "text").orderBy("lang", "rank").toLocalIterator():
        samples.setdefault(r.lang, []).append(r.text)
    return build(samples, chars)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score for each row; `und` with score 0 for null texts, texts without a letter, or no languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TABLE_BYTES at most, whatever the corpus
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        model = shared.value
        encoder = model.encoder()
        for batch in batches:
            for first, last in slices(batch.column(1)):
                out = model.predict(batch.column(1).slice(first, last - first).to_pylist(), encoder)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["key", "lang_pred", "score"])

    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double")
    return found.select(F.col("key").alias(key), "lang_pred", "score")


def slices(texts: pa.Array, most: int = 8 << 20) -> list[tuple[int, int]]:
    """Stretches of rows with about `most` bytes of text each: wide enough to work in step, and bounded in memory."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), len(texts)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]

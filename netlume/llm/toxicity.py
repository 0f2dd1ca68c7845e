"""Toxicity scores by a subsequence string kernel.

Words are compared by the characters that they have in common in order: every common subsequence of three characters
counts, weighted down by the gaps in it, so an insult with inserted characters stays near to itself.  Landmark words and
the Nystroem map turn the kernel into a vector, on which a linear support vector machine decides.  A text is judged by the
margins of the worst words of all of its sentences and by the shares of its words whose margins are high: chance finds a
few such words in a long text, toxicity has them all along.  A logistic curve turns these into a score.

The machine is trained on labelled sentences as bags of words (multiple instances): a text's label holds for the bag, and a
toxic bag has a witness.  The first witnesses are the fewest words that, rare elsewhere, occur in all toxic texts; then
each labelled sentence names the word of its highest margin, and the machine is fitted again with these.  All words of
other texts are examples to the contrary.  So toxicity of a phrase of ordinary words is not seen.  (A machine on whole
sentences, each the mean of its words in the same map, was tried: on held-out texts it found 0.17 of the toxic ones.)
Bounds of the fit: `TEXTS_KEPT` labelled texts of each class; 20 * `WITNESSES` suspect words, of which `WITNESSES` at most
are learnt, found in `ROUNDS` rounds, and as many named by sentences; `OTHERS` words to the contrary; `LANDMARKS`
landmarks, drawn from the first 12 candidates for each.  Scoring has no such bounds.  Copies of witnesses with inserted
characters are learnt too, and of the words to the contrary the ones most like an insult are looked up among all of the
sample.

Defined results: null and empty texts and texts without words of three characters score 0; equal texts score equally;
words of any length are looked at whole, in overlapping parts; without labels of both classes every text scores 0.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import workspace

TEXTS_KEPT = 4_000
LANDMARKS, ORDER, DECAY = 80, 3, 0.7
#: Longer words are looked at in parts of so many characters, each half of the part before and as much again.
PART = 24
WITNESSES, ROUNDS, OTHERS = 1_500, 5, 9_000
#: Rounds in which labelled sentences name their witnesses anew.
BAGS = 1
THRESHOLD = 0.7
#: The share of clean texts called toxic counts as so many times the share of toxic ones that are missed.
CLEAN = 1
#: Margins that count for a text, and the least that a margin counts for.
WORST, FLOOR = 5, -3.0
#: A text's shares of words beyond these margins count, that of all above the first by how far they are, and its length.
BEYOND, NEAR, FEW = (0.0, 0.5, 1.0), -1.0, 10
FEATURES = WORST + len(BEYOND) + 2
#: Least spread of each feature: one that hardly differs in the sample tells nothing of texts that differ in it.
SPREAD = np.array([0.25] * WORST + [0.005] * len(BEYOND) + [0.02, 0.5])
#: Largest table of subsequences' weights; beyond it they are looked up in order.
TABLE = 1 << 22
#: Words that a Python worker keeps with their margins; the memory is emptied when it is full.
WORDS_KEPT = 500_000
_EDGE = ".,;:!?\"'()[]{}<>|*#$%&+=~`^/\\-_«»„“”‚‘’¿¡…"
_SPELLED = re.compile(r" \S[ ]\S \S(?: \S)*(?= |$)")
_ENDS = re.compile(r"[.!?\n]+(?:\s+|$)")


def words(text: str) -> set[str]:
    """Distinct lower-cased words without marks at their ends; letters spelled out one by one count as a word too."""
    text = text.lower()
    out = {w.strip(_EDGE) for w in set(text.split())}
    if len(text) > 4:
        for m in _SPELLED.finditer(" " + text):
            out.add(m[0].replace(" ", ""))
    out.discard("")
    return out


def counted(text: str) -> tuple[dict[str, int], int]:
    """How often each of words() occurs, and how many words there are."""
    text = text.lower()
    raw = text.split()
    out: dict[str, int] = {}
    for w, n in Counter(raw).items():
        if w := w.strip(_EDGE):
            out[w] = out.get(w, 0) + n
    if len(text) > 4:
        for m in _SPELLED.finditer(" " + text):
            w = m[0].replace(" ", "")
            out[w] = out.get(w, 0) + 1
    out.pop("", None)
    return out, len(raw)


def sentences(text: str) -> list[str]:
    return [s for s in _ENDS.split(text) if s and not s.isspace()]


def parts(word: str) -> list[str]:
    """A word between marks of its beginning and end, in parts if it is long."""
    word = f"^{word}$"
    return [word] if len(word) <= PART else [word[k : k + PART] for k in range(0, len(word) - PART // 2, PART // 2)]


def coded(items: list[str], width: int, pad: int) -> np.ndarray:
    out = np.full((len(items), width), pad, np.int32)
    for k, w in enumerate(items):
        out[k, : len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def kernel(match: np.ndarray) -> np.ndarray:
    """Sums over common subsequences, for an array of which the last two axes tell equal characters."""
    here = match.astype(np.float32) * np.float32(DECAY**2)
    ends = here
    for _ in range(ORDER - 1):
        before = np.zeros_like(ends)
        for j in range(1, ends.shape[-2]):
            before[..., j, :] = before[..., j - 1, :] * np.float32(DECAY) + ends[..., j - 1, :]
        both = np.zeros_like(ends)
        for k in range(1, ends.shape[-1]):
            both[..., k] = both[..., k - 1] * np.float32(DECAY) + before[..., k - 1]
        ends = here * both
    return ends.sum(axis=(-1, -2))


def self_kernel(codes: np.ndarray) -> np.ndarray:
    return kernel((codes[:, :, None] == codes[:, None, :]) & (codes[:, :, None] >= 0))


@lru_cache(maxsize=64)
def subsequences(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of every subsequence of ORDER characters, and its weight."""
    at = np.array(list(combinations(range(size), ORDER)), np.int64).reshape(-1, ORDER)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1.0)


def subsequence_codes(x: np.ndarray, at: np.ndarray, base: int) -> np.ndarray:
    out = x[:, at[:, 0]]
    for k in range(1, ORDER):
        out = out * base + x[:, at[:, k]]
    return out


@dataclass
class Model:
    landmarks: list[str] = field(default_factory=list)
    #: Weights of the normalised kernel with each landmark, the Nystroem map included.
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    #: Of the logistic curve: a constant and a weight for each of a text's features.
    curve: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))

    def prepare(self) -> tuple[np.ndarray, np.ndarray]:
        codes = coded(self.landmarks, max(map(len, self.landmarks)), -2)
        own = np.where(codes < 0, -1, codes)
        return codes, np.sqrt(np.maximum(self_kernel(own), 1e-12))

    def likeness(self, items: list[str]) -> np.ndarray:
        """Normalised kernel of each item with each landmark."""
        codes, norm = self.prepare()
        out = np.zeros((len(items), len(self.landmarks)), np.float32)
        order = sorted(range(len(items)), key=lambda k: len(items[k]))
        for at in range(0, len(order), 256):
            chosen = order[at : at + 256]
            width = max(len(items[chosen[-1]]), 1)
            x = coded([items[k] for k in chosen], width, -1)
            mine = np.sqrt(np.maximum(self_kernel(x), 1e-12))
            found = kernel(np.moveaxis(x[:, :, None, None] == codes.T[None, None, :, :], 3, 1))
            out[chosen] = np.where(mine[:, None] > 1e-5, found / (mine[:, None] * norm[None, :]), 0)
        return out

    def explicit(self) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        """The decision in the kernel's own feature space: a weight for each subsequence that a landmark has.

        Returns the numbers of characters (0 for all others), codes of subsequences in order, and their weights.
        """
        if (made := self.__dict__.get("_explicit")) is None:
            alphabet = {c: k for k, c in enumerate(sorted(set("".join(self.landmarks))), 1)}
            _, norm = self.prepare()
            found: dict[int, float] = {}
            for word, w in zip(self.landmarks, self.weights / norm, strict=True):
                x = np.array([[alphabet[c] for c in word]])
                at, decay = subsequences(x.shape[1])
                for code, d in zip(subsequence_codes(x, at, len(alphabet) + 1)[0].tolist(), decay.tolist(), strict=True):
                    found[code] = found.get(code, 0.0) + w * d
            codes = np.array(sorted(found), np.int64)
            values = np.array([found[c] for c in codes.tolist()])
            if (size := (len(alphabet) + 1) ** ORDER) <= TABLE:
                values, codes = np.bincount(codes, values, minlength=size), codes[:0]
            made = self.__dict__["_explicit"] = alphabet, codes, values
        return made

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_explicit"}

    def decide(self, items: list[str]) -> np.ndarray:
        """The decision for each item: likeness() with the weights, computed by the item's own subsequences."""
        out = np.full(len(items), self.bias)
        if not items:
            return out
        alphabet, codes, values = self.explicit()
        number = {ord(c): k for c, k in alphabet.items()}
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(items):
            by_size.setdefault(len(w), []).append(k)
        for size, places in by_size.items():
            if size < ORDER:
                continue
            at, decay = subsequences(size)
            step = max(1, 400_000 // len(decay))
            for first in range(0, len(places), step):
                chosen = places[first : first + step]
                raw = np.frombuffer("".join([items[k] for k in chosen]).encode("utf-32-le", "surrogatepass"), np.int32).reshape(len(chosen), size)
                seen, back = np.unique(raw, return_inverse=True)
                x = np.array([number.get(c, 0) for c in seen.tolist()])[back].reshape(raw.shape)
                found = subsequence_codes(x, at, len(alphabet) + 1)
                if len(codes):
                    place = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
                    weight = np.where(codes[place] == found, values[place], 0)
                else:
                    weight = values[found]
                out[chosen] += (weight @ decay) / np.sqrt(self_kernel(raw))
        return out

    def margins(self, items: list[str]) -> np.ndarray:
        """The decision for each word, by its worst part."""
        cut = [parts(w) for w in items]
        value = self.decide([p for c in cut for p in c])
        starts = np.cumsum([0] + [len(c) for c in cut])[:-1]
        return np.maximum.reduceat(value, starts) if items else value[:0]

    def score(self, features: np.ndarray) -> np.ndarray:
        """Scores of texts by their features."""
        if not self.landmarks:
            return np.zeros(len(features))
        found = 1 / (1 + np.exp(-np.clip(self.curve[0] + features @ self.curve[1:], -30, 30)))
        return np.where(features[:, 0] <= FLOOR, 0.0, found)


class Judge:
    """Scores texts, remembering words."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Of each text the highest margins in order, FLOOR where there is none or it is lower, shares of words, and its length."""
        out = np.zeros((len(texts), FEATURES))
        out[:, :WORST] = FLOOR
        out[:, -1] = np.log(FEW)
        if not self.model.landmarks:
            return out
        found = [counted(t) if t else ({}, 0) for t in texts]
        fresh = set().union(*(f for f, _ in found)).difference(self.known)
        if len(self.known) + len(fresh) > WORDS_KEPT:
            self.known.clear()
            fresh = set().union(*(f for f, _ in found))
        long = sorted(w for w in fresh if len(w) >= ORDER)
        self.known.update((w, FLOOR) for w in fresh if len(w) < ORDER)
        self.known.update(zip(long, np.maximum(self.model.margins(long), FLOOR).tolist(), strict=True))
        for k, (f, n) in enumerate(found):
            if not f:
                continue
            margin = np.fromiter(map(self.known.__getitem__, f), float, len(f))
            often = np.fromiter(f.values(), float, len(f))
            top = heapq.nlargest(WORST, margin.tolist())
            out[k, : len(top)] = top
            shares = [often[margin > b].sum() for b in BEYOND] + [(np.clip(margin - NEAR, 0, 3) * often).sum()]
            out[k, WORST:-1] = np.array(shares) / (n + FEW)
            out[k, -1] = np.log(n + FEW)
        return out


_JUDGES: dict[int, Judge] = {}


def judge(name: int, model: Model) -> Judge:
    """Kept by the Python worker from task to task."""
    if name not in _JUDGES:
        _JUDGES.clear()
        _JUDGES[name] = Judge(model)
    return _JUDGES[name]


def separate(x: np.ndarray, y: np.ndarray, cost: float = 1e5, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, classes weighed equally, by Newton steps."""
    x1 = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * len(y)
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(x1.shape[1])
    for _ in range(rounds):
        live = y * (x1 @ w) < 1
        a = x1[live] * share[live, None]
        step = np.linalg.solve(ridge + 2 * cost / len(y) * (a.T @ x1[live]), 2 * cost / len(y) * (a.T @ y[live]))
        if np.abs(step - w).max() < 1e-6:
            break
        w = 0.5 * w + 0.5 * step if np.any(w) else step
    return w[:-1], float(w[-1])


def nystroem(model: Model) -> np.ndarray:
    """Inverse square root of the landmarks' own kernel."""
    k = model.likeness(model.landmarks).astype(float)
    value, vector = np.linalg.eigh((k + k.T) / 2)
    return vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T


def spread_out(items: list[str], n: int) -> list[str]:
    """Items in their order, each as unlike those before as can be found."""
    items = items[: 12 * n]
    if len(items) <= n:
        return items
    model = Model(items)
    k = model.likeness(items)
    chosen = [0]
    near = k[:, 0].copy()
    while len(chosen) < n:
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, k[:, chosen[-1]])
    return [items[c] for c in chosen]


def chosen_landmarks(bad: list[str], fine: list[str]) -> list[str]:
    cut = lambda found: [p for w in found for p in parts(w)]
    return list(dict.fromkeys(spread_out(cut(bad), LANDMARKS * 2 // 3) + spread_out(cut(fine), LANDMARKS // 3)))


def stretched(items: list[str], rng: np.random.Generator) -> list[str]:
    """Items with one or two characters put between others."""
    out = []
    for w in items:
        for n in (1, 2):
            s = w
            for _ in range(n):
                at = int(rng.integers(1, max(len(s), 2)))
                s = s[:at] + str(rng.choice(list(".-*_x1 "))).strip() + s[at:]
            out.append(s)
    return out


def witnesses(by_text: dict[str, list[int]], least: int, often: int) -> list[str]:
    """Fewest words that occur in all texts, found greedily, each in `least` texts that those before are not in.

    Texts may hold several insults, so further rounds go on with the words not chosen, each in `often` texts.
    """
    out: list[str] = []
    for k in range(ROUNDS):
        left = {w: set(t) for w, t in by_text.items() if w not in out}
        while left and len(out) < WITNESSES:
            best = max(left, key=lambda w: (len(left[w]), len(by_text[w]), w))
            if len(new := left.pop(best)) < (often if k else least) and out:
                break
            out.append(best)
            left = {w: r for w, t in left.items() if (r := t - new)}
    return out


def sample(docs: DataFrame, labels: DataFrame, kept: int, key: str, text: str) -> DataFrame:
    """key, text, toxic of at most `kept` labelled texts of each class."""
    one = labels.filter(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(key).alias("labelled")).agg(F.max("toxic").cast("int").alias("toxic"))
    first = lambda c: one.filter(F.col("toxic") == c).orderBy(F.xxhash64("labelled"), "labelled").limit(kept)
    return docs.select(F.col(key), F.col(text)).join(F.broadcast(first(0).unionByName(first(1))), F.col(key) == F.col("labelled")).select(F.col(key).alias("key"), F.col(text).alias("text"), "toxic")


def fit(docs: DataFrame, labels: DataFrame, kept: int = TEXTS_KEPT, key: str = "doc_id", text: str = "text") -> Model:
    rows = workspace.written(sample(docs, labels, kept, key, text).filter(F.col("text").isNotNull()), "labelled")
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return Model()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                keys, found, toxic = [], [], []
                for k, t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    own = set().union(*map(words, sentences(t))) if t else set()
                    own = [w for w in own if len(w) >= ORDER]
                    keys += [k] * len(own)
                    found += own
                    toxic += [y] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.string()), pa.array(toxic, pa.int32())], ["key", "word", "toxic"])

    each = workspace.written(rows.select(F.xxhash64("key", "text").alias("key"), "text", "toxic").mapInArrow(split, "key bigint, word string, toxic int"), "words")
    counted = each.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("fine"))
    odds = ((F.col("bad") + 0.5) / (totals[1] + 1)) / ((F.col("fine") + 0.5) / (totals[0] + 1))
    counted = workspace.written(counted.withColumn("odds", odds), "counted")
    suspects = counted.filter("bad >= 2 AND odds >= 8").orderBy(F.desc("odds"), "word").limit(20 * WITNESSES)
    by_text: dict[str, list[int]] = {}
    for r in each.filter("toxic = 1").join(F.broadcast(suspects.select("word")), "word").select("word", "key").collect():
        by_text.setdefault(r["word"], []).append(r["key"])
    bad = witnesses(by_text, max(2, totals[1] // 1000), max(2, totals[1] // 20))
    if not bad:
        return Model()
    clean = counted.filter("fine > 0 AND odds < 1.5")
    fine = [r["word"] for r in clean.orderBy(F.desc("fine"), "word").limit(OTHERS // 3).collect()] + [r["word"] for r in clean.orderBy(F.xxhash64("word"), "word").limit(OTHERS // 3).collect()]
    rng = np.random.default_rng(5)
    positive: list[str] = []

    def take(found: list[str]) -> None:
        positive.extend(p for w in found + stretched(found, rng) for p in parts(w))

    take(bad)
    model = Model(chosen_landmarks(bad, fine))
    shape = nystroem(model)

    def learn(negative: list[str]) -> None:
        x = np.concatenate((model.likeness(positive), model.likeness(negative))) @ shape
        y = np.concatenate((np.ones(len(positive)), -np.ones(len(negative))))
        w, model.bias = separate(x, y)
        model.weights = shape @ w

    negative = [p for w in dict.fromkeys(fine) for p in parts(w)]
    learn(negative)
    worst = measured(clean.select("word"), model).orderBy(F.desc("margin"), "word").limit(OTHERS // 3).collect()
    negative = list(dict.fromkeys(negative + [p for r in worst for p in parts(r["word"])]))
    learn(negative)
    for _ in range(BAGS):
        seen = set(bad)
        more = [w for w in sentence_witnesses(rows.filter("toxic = 1"), model, max(2, totals[1] // 1000)) if w not in seen]
        if not more:
            break
        bad += more
        take(more)
        learn(negative)
    known = judged(rows, model, "key", "text", ["toxic"]).select("toxic", "features").toPandas()  # TEXTS_KEPT rows of each class at most
    model.curve = fitted_curve(np.array(known["features"].tolist(), float), known["toxic"].to_numpy() == 1)
    return model


def sentence_witnesses(rows: DataFrame, model: Model, least: int) -> list[str]:
    """Words of the highest margin, if it is positive, in `least` sentences of toxic texts or more; WITNESSES at most, the most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge_ = Judge(model)
        for b in batches:
            found: Counter[str] = Counter()
            for text in b.column(0).to_pylist():
                said = [words(s) for s in sentences(text or "")]
                judge_.features([text])
                for ws in said:
                    known = [(judge_.known[w], w) for w in ws if w in judge_.known]
                    if known and (top := max(known))[0] > 0:
                        found[top[1]] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    counted = rows.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(WITNESSES).collect()]


def fitted_curve(features: np.ndarray, toxic: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Logistic regression, classes weighed equally, moved so that scores reach THRESHOLD where the fewest are wrong."""
    middle, spread = features.mean(axis=0), np.maximum(features.std(axis=0), SPREAD)
    x = np.concatenate((np.ones((len(features), 1)), (features - middle) / spread), axis=1)
    share = np.where(toxic, 0.5 / max(toxic.sum(), 1), 0.5 / max((~toxic).sum(), 1)) * len(x)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = x.T @ (share * (toxic - p)) - 0.05 * w
        w = w + np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w)), step)
    w[0] += np.log(THRESHOLD / (1 - THRESHOLD)) - middle_cut(x @ w, toxic)
    w[1:] /= spread
    w[0] -= middle @ w[1:]
    return w


def middle_cut(margin: np.ndarray, toxic: np.ndarray) -> float:
    """The value that leaves the smallest shares of both classes on the wrong side, clean texts counting more, in the middle of its gap."""
    order = np.argsort(margin, kind="stable")
    m, t = margin[order], toxic[order]
    wrong = np.concatenate(([0], np.cumsum(t))) / max(t.sum(), 1) + CLEAN * ((~t).sum() - np.concatenate(([0], np.cumsum(~t)))) / max((~t).sum(), 1)
    at = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    ends = np.concatenate(([m[0] - 1], m, [m[-1] + 1]))
    best = at[int(np.argmax(np.diff(ends)[at]))]
    return float((ends[best] + ends[best + 1]) / 2)


def measured(found: DataFrame, model: Model) -> DataFrame:
    """word, margin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.margins(part.column(0).to_pylist()), pa.float64())], ["word", "margin"])

    return found.mapInArrow(run, "word string, margin double")


def judged(docs: DataFrame, model: Model, key: str, text: str, kept: list[str] = ()) -> DataFrame:
    """key, features and score of every row, and the columns in `kept`."""
    kinds = dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = int(np.random.default_rng().integers(1 << 62))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = judge(name, shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = j.features(part.column(1).to_pylist())
                more = [part.column(2 + k) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([part.column(0), *more, pa.array(found.tolist(), pa.list_(pa.float64())), pa.array(j.model.score(found))], [key, *kept, "features", "score"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [key, *kept])
    return docs.select(key, text, *kept).mapInArrow(run, f"{schema}, features array<double>, score double")


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, predicted: one row for each document."""
    found = judged(docs, model, key, text)
    return found.select(key, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Toxicity by weak supervision.

Many lexicon and pattern voters each say "toxic" or abstain, and a label, where a training row has one, is one more voter.
A generative label model estimates in one likelihood, over the vote patterns of all documents, each voter's accuracy, the
correlations between voters given the class, and how often labels are right. A linear classifier is trained on the model's
posterior labels of a bounded sample of documents, most of them without a label. A score is computed from the text alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, written

LETTERS = re.compile(r"[^\W\d_]+")
#: Insults and abuse by theme, in the languages of the corpus.
LEXICONS = {
    "ability": "idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile retard fool dunce clown dumm dummkopf trottel idiota imbécil estúpido tonto idiote imbécile stupide crétin",
    "worth": "loser losers worthless pathetic useless trash garbage scum vermin failure abschaum versager wertlos müll basura inútil perdedor escoria ordure nul minable perdant",
    "disgust": "disgusting vile filthy filth gross repulsive revolting ekelhaft widerlich asqueroso repugnante dégoûtant répugnant",
    "threat": "kill die hang shoot stab burn murder lynch töten sterben matar muere tuer crève",
    "profane": "fuck fucking fucker shit shitty bitch bastard asshole cunt dick whore slut scheiße arschloch hure mierda puta cabrón merde putain salope connard",
}
PATTERNS = {
    "address": re.compile(r"\b(?:you|you're|youre|ur|du bist|tu es|eres)\b[^.!?\n]{0,24}\b(?:idiot|moron|stupid|loser|pathetic|worthless|disgusting|trash|scum|clown|dumm|idiota|stupide)", re.I),
    "masked": re.compile(r"\b[a-zA-Z][*#@$]{2,}[a-zA-Z]{0,4}\b"),
    "shouted": re.compile(r"\b(?:IDIOT|MORON|STUPID|LOSER|PATHETIC|WORTHLESS|DISGUSTING|TRASH|SCUM|CLOWN)\b"),
}
PREFIXES = (4, 5, 6)
LEARNED = 6
VOTERS = [*LEXICONS, *PATTERNS, *(f"learned{k}" for k in range(LEARNED))]
_THEMES = {w: k for k, words in enumerate(LEXICONS.values()) for w in words.split()}


@dataclass
class Lexicon:
    """Words and word beginnings ("lowe-") learned from training rows; each has a number and a learned voter. halves has, by
    number, which halves of the training rows mark the feature on their own, as bits."""

    numbers: dict[str, int] = field(default_factory=dict)
    halves: list[int] = field(default_factory=list)

    def features(self, words: set[str]) -> list[int]:
        get, out = self.numbers.get, set()
        for w in words:
            if (k := get(w)) is not None:
                out.add(k)
            for n in PREFIXES:
                if len(w) > n and (k := get(w[:n] + "-")) is not None:
                    out.add(k)
        return sorted(out)


def words_of(text: str | None) -> set[str]:
    return set(LETTERS.findall(text.lower())) if text else set()


def votes(text: str | None, words: set[str], features: list[int]) -> int:
    """The voters' votes as bits, in the order of VOTERS; features are those that may vote."""
    out = 0
    for w in words & _THEMES.keys():
        out |= 1 << _THEMES[w]
    if text:
        for k, pattern in enumerate(PATTERNS.values(), len(LEXICONS)):
            if pattern.search(text):
                out |= 1 << k
    for f in features:
        out |= 1 << (len(LEXICONS) + len(PATTERNS) + f % LEARNED)
    return out


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_labels(labels: DataFrame, most: int) -> DataFrame:
    """At most `most` labelled ids that are not held out, in hash order: (doc_id, toxic, half)."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    rows = rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return rows.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int"))


def learn_lexicon(train: DataFrame, least: int = 5) -> Lexicon:
    """The words and word beginnings that mark toxic training rows (doc_id, text, toxic, half).

    A feature needs `least` toxic rows and a log-odds of 2 standard errors above 2.5. Counted and decided on the executors;
    those that are marked go to the driver, at most the vocabulary of the training rows.
    """
    total = {(r.toxic, r.half): r.n for r in train.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[tuple[str, int, int]] = Counter()
        for b in batches:
            for text, toxic, half in zip(b["text"], b["toxic"], b["half"], strict=True):
                words = words_of(text)
                words |= {w[:n] + "-" for w in words for n in PREFIXES if len(w) > n}
                seen.update((w, toxic, half) for w in words)
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["feature", "toxic", "half", "n"])

    def has(toxic: int, halves: tuple[int, ...]) -> F.Column:
        return F.sum(F.when((F.col("toxic") == toxic) & F.col("half").isin(*halves), F.col("n")).otherwise(0))

    def mark(name: str, halves: tuple[int, ...]) -> F.Column:
        p, q = (F.col(f"{name}{t}") + 0.5 for t in (1, 0))
        m1, m0 = (sum(total.get((t, h), 0) for h in halves) for t in (1, 0))
        error = F.sqrt(1 / p + 1 / (m1 + 1 - p) + 1 / q + 1 / (m0 + 1 - q))
        return F.when(F.col(f"{name}1") >= least, F.log(p / (m1 + 1 - p)) - F.log(q / (m0 + 1 - q)) - 2 * error).otherwise(0.0)

    sides = {"all": (0, 1), "first": (0,), "second": (1,)}
    found = train.select("text", "toxic", "half").mapInPandas(counts, "feature string, toxic int, half int, n long").groupBy("feature")
    found = found.agg(*[has(t, halves).alias(f"{name}{t}") for name, halves in sides.items() for t in (1, 0)])
    marks = found.select("feature", *[mark(name, halves).alias(name) for name, halves in sides.items()]).where("all > 2.5").collect()
    marks.sort(key=lambda r: (-r["all"], r.feature))
    return Lexicon({r.feature: k for k, r in enumerate(marks)}, [(r.first > 2.5) + 2 * (r.second > 2.5) for r in marks])


def unpack(pattern: np.ndarray) -> np.ndarray:
    return ((pattern[:, None] >> np.arange(len(VOTERS))) & 1).astype(float)


PAIRS = np.triu_indices(len(VOTERS), 1)


def terms(bits: np.ndarray) -> np.ndarray:
    """The votes, and the products of all pairs of votes."""
    return np.hstack([bits, bits[:, PAIRS[0]] * bits[:, PAIRS[1]]])


@dataclass
class LabelModel:
    """A latent class. Given the class, a vote pattern's log-probability is linear in the votes and in the products of two
    votes: the weights of products are the correlations that the class does not explain. label is how often a label says
    toxic, by class (clean, toxic)."""

    prior: float
    weights: np.ndarray
    log_total: np.ndarray
    rates: np.ndarray
    label: np.ndarray

    def log_odds(self, bits: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
        """Of class toxic; state: 1 or 0 where a label says so, -1 without one."""
        odds = np.log(self.prior / (1 - self.prior)) + terms(bits) @ (self.weights[1] - self.weights[0]) - (self.log_total[1] - self.log_total[0])
        if state is not None:
            clean, toxic = self.label
            odds = odds + np.where(state == 1, np.log(toxic / clean), np.where(state == 0, np.log((1 - toxic) / (1 - clean)), 0.0))
        return np.clip(odds, -30, 30)

    def posterior(self, bits: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(bits, state)))

    def correlations(self) -> np.ndarray:
        """Weights of pairs of votes, (class, voter, voter)."""
        n, out = len(VOTERS), np.zeros((2, len(VOTERS), len(VOTERS)))
        for c in range(2):
            out[c][PAIRS] = self.weights[c, n:]
            out[c] += out[c].T
        return out


def _match(every: np.ndarray, weights: np.ndarray, wanted: np.ndarray, size: float, ridge: float, steps: int = 25) -> tuple[np.ndarray, float]:
    """Weights whose expected terms over all patterns are those wanted (Newton's method on the likelihood of `size` rows, with
    a ridge on pairs), and the log of the patterns' sum."""
    n = len(VOTERS)
    pull = np.where(np.arange(every.shape[1]) < n, 1e-6, ridge)

    def state(w: np.ndarray) -> tuple[float, np.ndarray, float]:
        z = every @ w
        top = z.max()
        p = np.exp(z - top)
        log_total = float(top + np.log(p.sum()))
        return size * (w @ wanted - log_total) - (pull * w * w).sum() / 2, p / p.sum(), log_total

    value, p, log_total = state(weights)
    for _ in range(steps):
        mean = p @ every
        hessian = size * ((every * p[:, None]).T @ every - np.outer(mean, mean)) + np.diag(pull)
        move = np.linalg.solve(hessian + 1e-9 * size * np.eye(len(mean)), size * (wanted - mean) - pull * weights)
        for shrink in (1.0, 0.3, 0.1, 0.01):
            now = state(weights + shrink * move)
            if now[0] >= value:
                break
        gain = now[0] - value
        if gain >= 0:
            weights, (value, p, log_total) = weights + shrink * move, now
        if gain < 0.01:
            break
    return weights, log_total


def fit_label_model(pattern: np.ndarray, state: np.ndarray, count: np.ndarray, rounds: int = 40, ridge: float = 1.0) -> LabelModel:
    """EM over vote patterns and labels: state is 1 or 0 where a label says so and -1 without one.

    The voters' terms given the class are matched exactly by sums over all 2**14 patterns. Voters know better than chance:
    the rates of a vote and of two votes together among clean documents are held below those among toxic ones. A label's
    rates start from 19 right of 20, which counts as ten labels and a tenth of those seen. The first round believes labels.
    """
    n = len(VOTERS)
    bits, every = unpack(pattern), terms(unpack(np.arange(1 << n)))
    mine = terms(bits)
    rates = np.stack([np.full(n, 0.01), np.full(n, 0.3)])
    start = np.hstack([np.log(rates / (1 - rates)), np.zeros((2, len(PAIRS[0])))])
    model = LabelModel(0.1, start, -np.log(1 - rates).sum(axis=1), rates, np.array([0.05, 0.95]))
    seen = state >= 0
    firm = 10 + count[seen].sum() / 10
    before = np.zeros(len(count))
    for k in range(rounds):
        toxic = model.posterior(bits, state) if k else np.where(seen, np.where(state == 1, 0.95, 0.05), model.posterior(bits))
        if k and np.abs(toxic - before).max(initial=0) < 1e-3:
            break
        before = toxic
        model.prior = float(np.clip(((count * toxic).sum() + 1) / (count.sum() + 10), 1e-4, 0.9))
        wanted, sizes = [], []
        for c, few in ((1, 0.3), (0, 0.01)):
            w = count * (toxic if c else 1 - toxic)
            like = np.concatenate([np.full(n, few), np.full(len(PAIRS[0]), few * few)])
            wanted.append((w @ mine + like) / (w.sum() + 1))
            sizes.append(w.sum() + 1)
            model.label[c] = ((w * (state == 1)).sum() + (0.95 if c else 0.05) * firm) / ((w * seen).sum() + firm)
        wanted[1] = np.minimum(wanted[1], wanted[0] / 1.05)
        for c in (0, 1):
            model.rates[c] = wanted[1 - c][:n]
            model.weights[c], model.log_total[c] = _match(every, model.weights[c], wanted[1 - c], sizes[1 - c], ridge)
    return model


def fit_linear(features: list[np.ndarray], size: int, target: np.ndarray, ridge: float = 0.02, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse 0/1 features with soft targets, by Adam on the whole sample."""
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    cols = np.concatenate([*features, np.zeros(0, np.int64)]).astype(np.int64)
    w, b, n = np.zeros(size), -2.0, max(1, len(features))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = np.bincount(rows, w[cols], len(features)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        grad = np.append(np.bincount(cols, g[rows], size) + ridge * w / n, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def score_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = 16_000, key: str | None = None) -> DataFrame:
    """A score for every row of docs (doc_id, text): doc_id, held_out, score, predicted, votes, posterior.

    At most `train_rows` labelled rows that are not held out teach the lexicon. The label model is fitted to the vote patterns
    of all documents: a pattern is 14 bits, so the driver gets at most 3 * 2**14 counts. What it learns from a labelled row
    are votes of words that the other half of these rows marks, so no label judges what it has taught. The classifier is trained on the posterior labels of those labelled rows and
    of as many documents again, without a label and not held out, in hash order. labels (doc_id, toxic); a document
    labelled twice counts as toxic if either label says so. Null and empty texts get the score of no evidence. Repeated
    rows are scored each. Without labels of both classes the label model's posterior is the score. key names a binary column
    of docs that goes along with each row, as the last column.
    """
    small_batches(docs.sparkSession)
    sample = F.broadcast(training_labels(labels, train_rows))  # train_rows rows of three numbers at most
    extra, kind = ([key], f", {key} binary") if key else ([], "")
    lexicon = learn_lexicon(docs.select("doc_id", "text").join(sample, "doc_id"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for text, half in zip(b["text"], b["half"], strict=True):
                words = words_of(text)
                features = lexicon.features(words)
                own = features if half < 0 else [f for f in features if lexicon.halves[f] >> (1 - half) & 1]
                found.append((votes(text, words, features), votes(text, words, own), features))
            yield pd.concat([b[["doc_id", "state"]], pd.DataFrame(found, columns=["votes", "seen", "features"], index=b.index), b[extra]], axis=1)

    rows = docs.select("doc_id", "text", *extra).join(sample, "doc_id", "left")
    rows = rows.select("doc_id", "text", F.coalesce("toxic", F.lit(-1)).alias("state"), F.coalesce("half", F.lit(-1)).alias("half"), *extra)
    seen = rows.mapInPandas(look, f"doc_id long, state int, votes int, seen int, features array<int>{kind}")
    seen = written(seen, "toxicity-votes")
    counts = seen.groupBy("seen", "state").agg(F.count("*").alias("n")).toPandas()
    model = fit_label_model(counts["seen"].to_numpy(np.int64), counts["state"].to_numpy(), counts["n"].to_numpy(float))
    linear, both = None, counts.loc[counts["state"] >= 0, "state"].nunique() == 2
    if both:
        # a repeated doc_id's rows all have its label, so the labelled rows are bounded like the others
        order = F.xxhash64("doc_id", F.lit("train")), "doc_id", "votes", F.hash("features")
        some = [seen.where(w).orderBy(*order).limit(train_rows).select("votes", "state", "features") for w in (F.col("state") >= 0, (F.col("state") < 0) & ~held_out())]
        train = some[0].unionByName(some[1]).toPandas()
        bits = unpack(train["votes"].to_numpy(np.int64))
        size = len(lexicon.numbers)
        known = [np.concatenate([np.asarray(f, np.int64), size + np.flatnonzero(v)]) for f, v in zip(train["features"], bits, strict=True)]
        linear = fit_linear(known, size + len(VOTERS), model.posterior(bits, train["state"].to_numpy()))

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bits = unpack(b["votes"].to_numpy(np.int64))
            posterior = model.posterior(bits)
            score = posterior
            if linear is not None:
                w, bias = linear
                known = len(w) - len(VOTERS)
                z = bits @ w[known:] + bias + np.array([w[np.asarray(f, np.int64)].sum() for f in b["features"]])
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": score, "votes": b["votes"], "posterior": posterior} | {c: b[c] for c in extra})

    out = seen.select("doc_id", "votes", "features", *extra).mapInPandas(rate, f"doc_id long, score double, votes int, posterior double{kind}")
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "votes", "posterior", *extra)

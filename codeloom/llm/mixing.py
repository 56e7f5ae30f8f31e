"""Mixing sources to target shares of all tokens.

Softmax classifiers, fitted on two halves of a bounded sample of labelled documents, predict from the tokens of a text
the source it comes from; each document is judged by the one that hasn't seen it.  How far labels can be trusted
is estimated from the same held-out posteriors: with them, a document whose label its text contradicts becomes a
member of another source.  Nonnegative rates of the documents, at most the allowed repeats, are then fitted by
projected gradient steps on the squared relative errors of the sources' token totals, by label and as expected
from the memberships.  They start uniform.  Rates are the projection of the sum of all steps, so a pass needs that sum
and no history; each pass is one aggregation over all documents, which also gives the curvature that scales the step.
Rates become whole repeats by error diffusion within small groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.tokens import token_table, tokenizer_path
from codeloom.session import pin

#: Bound of the labelled sample per source that the classifier is fitted on, and its number of hashed features.
SAMPLE_PER_SOURCE, FEATURES = 800, 1024
#: Passes over the documents at most, the relative error of a total that ends them, and how many passes may bring no gain.
PASSES, TOLERANCE, STALL = 40, 2e-4, 4
#: Stiffness of the totals, as a share of a mix's tokens: those by label are met as they are, those expected from
#: memberships as far as the documents allow.
STIFF_LABEL, STIFF_MEMBER = 1e-7, 0.05
#: Distinct pairs of mix and source at most; they are held by the driver.  More are refused.
MOST_TARGETS = 10_000
#: Documents of a group within which rounding errors are passed on.
GROUP = 2_000
CHOSEN = "mix_name string, doc_id long, source string, n_tokens int, repeats int"


def features(ids: bytes, counts: bytes) -> np.ndarray:
    """Hashed, damped and normed token counts."""
    bucket = (np.frombuffer(ids, dtype=np.uint32).astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(12)) % np.uint64(FEATURES)
    row = np.bincount(bucket.astype(np.int64), weights=np.log1p(np.frombuffer(counts, dtype=np.uint32)), minlength=FEATURES)
    return row / (np.linalg.norm(row) or 1.0)


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 300, rate: float = 8.0, penalty: float = 1e-4) -> np.ndarray:
    """Weights (FEATURES + 1, classes) by full gradient steps with momentum; deterministic."""
    x = np.hstack([x, np.ones((len(x), 1))])
    goal = np.eye(classes)[y]
    share = goal.mean(axis=0)
    weight = (goal / np.maximum(share, 1e-9)).sum(axis=1, keepdims=True)
    weight /= weight.sum()
    w, v = np.zeros((x.shape[1], classes)), np.zeros((x.shape[1], classes))
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        v = 0.9 * v - rate * (x.T @ ((p - goal) * weight) + penalty * w)
        w = w + v * 0.1
    return w


def predict(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    z = np.hstack([x, np.ones((len(x), 1))]) @ w
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def label_chance(posterior: np.ndarray, label: np.ndarray) -> np.ndarray:
    """P(label | source), rows being sources, from held-out posteriors of labelled documents; one count of each label is assumed beforehand."""
    n = posterior.shape[1]
    chance = np.full((n, n), 1.0 / n) + np.array([posterior[label == k].sum(axis=0) for k in range(n)]).reshape(n, n).T
    return chance / chance.sum(axis=1, keepdims=True)


def membership(posterior: np.ndarray, label: np.ndarray, chance: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Chance of each source given text and label; ``label`` is -1 where unknown.

    A classifier fitted on labels predicts labels, wrong ones included; rounds of expectation and maximisation find the
    sources that with ``chance`` would give them.
    """
    posterior = np.maximum(posterior, 1e-6)
    seen = posterior
    for _ in range(rounds):
        posterior = posterior * ((seen / (posterior @ chance)) @ chance.T)
    given = np.ones_like(posterior)
    given[label >= 0] = chance[:, label[label >= 0]].T
    joint = np.maximum(posterior, 1e-6) * given
    return joint / joint.sum(axis=1, keepdims=True)


def _sample_hash() -> Column:
    """A number below 2^30 of a document; its parity is the half of the sample it belongs to."""
    return F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))


def labelled_sample(vectors: DataFrame, sources: list[str]) -> pd.DataFrame:
    """At most SAMPLE_PER_SOURCE documents a source, by the smallest hashes; a first cut by hash is made before anything is sorted."""
    own = vectors.where(F.col("source").isin(sources) & (F.col("n_tokens") > 0)).withColumn("h", _sample_hash())
    sizes = own.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    likely = own.join(F.broadcast(sizes), "source").where(F.col("h") < F.lit(1 << 30) * (F.lit(2.0 * SAMPLE_PER_SOURCE) / F.col("n")))  # sizes: one row per source of the mixes
    return likely.select("doc_id", "source", "ids", "counts", "h").toPandas().sort_values("h").groupby("source").head(SAMPLE_PER_SOURCE)


class Problem:
    """The mixes as arrays: targets and caps, per mix and source."""

    def __init__(self, targets: pd.DataFrame, tokens: dict[str, float]):
        self.sources = sorted(s for s in targets["source"].unique() if tokens.get(s, 0) > 0)
        self.mixes = sorted(targets["mix_name"].unique())
        index = {s: k for k, s in enumerate(self.sources)}
        self.cap = np.zeros((len(self.mixes), len(self.sources)))
        self.share = np.zeros_like(self.cap)
        for row in targets.itertuples():
            if row.source in index and row.weight > 0 and row.max_repeats > 0:
                m, s = self.mixes.index(row.mix_name), index[row.source]
                self.share[m, s] += row.weight
                self.cap[m, s] = max(self.cap[m, s], row.max_repeats)
        self.share /= np.maximum(self.share.sum(axis=1, keepdims=True), 1e-12)
        have = np.array([tokens[s] for s in self.sources]) if self.sources else np.zeros(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            room = np.where(self.share > 0, have * self.cap / self.share, np.inf)
        #: The most tokens at which every source can have its share.
        self.size = np.where(np.isfinite(room.min(axis=1)), room.min(axis=1), 0.0) if self.sources else np.zeros(len(self.mixes))
        self.goal = self.share * self.size[:, None]
        eligible = np.where(self.share > 0, have, 0.0).sum(axis=1)
        #: The uniform rate that gives the mix its size.
        self.start = np.divide(self.size, eligible, out=np.zeros_like(self.size), where=eligible > 0)

    def rates(self, member: np.ndarray, label: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rates (mixes, documents) after ``steps`` (mixes, 2 sources: by label, by membership), and which of them are free to move."""
        n = len(self.sources)
        cap = np.where(label >= 0, self.cap[:, label], 0.0)
        raw = self.start[:, None] + np.where(label >= 0, steps[:, :n][:, label], 0.0) + steps[:, n:] @ member.T
        return np.clip(raw, 0.0, cap), (raw > 0) & (raw < cap)


@dataclass
class Fit:
    """What the fit came to: passes made, largest relative errors of the totals by label and by membership, whether it met TOLERANCE."""

    passes: int
    label_error: float
    member_error: float
    met: bool


def _encoded(batch: pd.DataFrame, index: dict[str, int], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    member = np.stack(batch["member"].to_numpy()) if len(batch) else np.zeros((0, n))
    return member, batch["source"].map(index).fillna(-1).to_numpy(dtype=np.int64), batch["n_tokens"].to_numpy(dtype=np.float64)


def fit_rates(soft: DataFrame, problem: Problem) -> tuple[np.ndarray, Fit]:
    """Steps (mixes, 2 sources) that bring the totals to their goals, one pass over ``soft`` each.

    A pass sums, per mix, the tokens each source gets by label and by membership, and the curvature: how the totals
    move with the steps, over the documents whose rates are free.  A step that brings no gain is halved; STALL of
    them in a row, or PASSES in all, end the fit, and what is left of the errors is reported.
    """
    n, mixes = len(problem.sources), len(problem.mixes)
    index = {s: k for k, s in enumerate(problem.sources)}
    used = np.hstack([problem.share > 0, problem.share > 0])
    goal = np.hstack([problem.goal, problem.goal])
    stiff = np.repeat([STIFF_LABEL, STIFF_MEMBER], n) * np.maximum(problem.size, 1.0)[:, None]

    def totals(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums, curve = np.zeros((mixes, 2 * n)), np.zeros((mixes, 2 * n, 2 * n))
            for batch in batches:
                member, label, size = _encoded(batch, index, n)
                both = np.hstack([(label[:, None] == np.arange(n)).astype(float), member])
                rate, free = problem.rates(member, label, steps)
                sums += (rate * size) @ both
                for m in range(mixes):
                    curve[m] += (both * (free[m] * size)[:, None]).T @ both
            flat = np.concatenate([sums.ravel(), curve.ravel()])
            yield pd.DataFrame({"k": np.arange(len(flat)), "t": flat})

        flat = np.zeros(mixes * 2 * n * (1 + 2 * n))
        for row in soft.select("source", "n_tokens", "member").mapInPandas(run, "k int, t double").groupBy("k").agg(F.sum("t").alias("t")).collect():
            flat[row["k"]] = row["t"]
        return flat[: mixes * 2 * n].reshape(mixes, 2 * n), flat[mixes * 2 * n :].reshape(mixes, 2 * n, 2 * n)

    steps, best, step, worst, stalled, fit = np.zeros((mixes, 2 * n)), None, None, np.inf, 0, Fit(0, np.inf, np.inf, False)
    for passes in range(1, PASSES + 1):
        reached, curve = totals(steps)
        wrong = np.where(used, reached - goal + stiff * steps, 0.0)  # the gradient of squared errors and squared steps
        error = np.abs(np.divide(reached - goal, goal, out=np.zeros_like(goal), where=goal > 0))
        size = float(np.abs(np.divide(wrong, goal, out=np.zeros_like(goal), where=goal > 0)).max())
        if size < worst:
            best, worst, stalled = steps, size, 0
            fit = Fit(passes, float(error[:, :n].max()), float(error[:, n:].max()), size < TOLERANCE)
            if fit.met:
                break
            step = np.zeros_like(steps)
            for m in range(mixes):
                on = np.flatnonzero(used[m])
                if len(on):
                    step[m, on] = -np.linalg.solve(curve[m][np.ix_(on, on)] + np.diag(stiff[m, on] + 1e-12), wrong[m, on])
        else:
            stalled, step = stalled + 1, step / 2
            if stalled == STALL:
                break
        steps = best + step
    return best, fit


def chosen(documents: DataFrame, mix_targets: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame, Fit]:
    """(chosen documents, shares reached, how the fit ended).

    Of each mix as many tokens are chosen as the scarcest source allows.  Weights are relative within the mix;
    sources without documents are left out and the others take their part.  Rows of mix_targets that lack a name,
    a source, a positive weight or repeats are ignored.  A document without a label of the mix is never chosen.
    ``mix_targets`` is a small dimension; more than MOST_TARGETS pairs of mix and source are refused.
    """
    path = path or tokenizer_path()
    spark = documents.sparkSession
    wanted = mix_targets.where("mix_name is not null and source is not null and weight > 0 and max_repeats > 0")
    targets = wanted.groupBy("mix_name", F.lower(F.trim("source")).alias("source")).agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    if targets.count() > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} pairs of mix and source")
    targets = targets.orderBy("mix_name", "source").toPandas()
    vectors = pin(token_table(documents, path).where("n_tokens > 0").dropDuplicates(["doc_id"]), "vectors")
    held = {r["source"]: float(r["t"]) for r in vectors.where(F.col("source").isin(sorted(targets["source"].unique().tolist()) or [""])).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    problem = Problem(targets, held)
    n = len(problem.sources)
    if not n or not problem.mixes:
        empty = spark.createDataFrame([], CHOSEN)
        return empty, shares(empty, targets, spark), Fit(0, 0.0, 0.0, True)
    index = {s: k for k, s in enumerate(problem.sources)}
    sample = labelled_sample(vectors, problem.sources)
    x = np.array([features(a, b) for a, b in zip(sample["ids"], sample["counts"])]).reshape(-1, FEATURES)
    y, fold = sample["source"].map(index).to_numpy(dtype=np.int64), (sample["h"].to_numpy() % 2).astype(int)
    weights = [fit_softmax(x[fold != k], y[fold != k], n) for k in range(2)]  # of each document the one fitted on the other half
    chance = label_chance(np.vstack([predict(weights[k], x[fold == k]) for k in range(2)]), np.concatenate([y[fold == k] for k in range(2)]))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            label = batch["source"].map(index).fillna(-1).to_numpy(dtype=np.int64)
            rows = np.array([features(a, b) for a, b in zip(batch["ids"], batch["counts"])]).reshape(-1, FEATURES)
            both = np.stack([predict(w, rows) for w in weights])
            soft = membership(both[batch["fold"].to_numpy().astype(int), np.arange(len(rows))], label, chance)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "n_tokens": batch["n_tokens"], "member": list(soft)})

    folded = vectors.select("doc_id", "source", "n_tokens", "ids", "counts", (_sample_hash() % 2).alias("fold"))
    soft = pin(folded.mapInPandas(judge, "doc_id long, source string, n_tokens int, member array<double>"), "soft")
    steps, fit = fit_rates(soft, problem)

    def rated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            member, label, _ = _encoded(batch, index, n)
            found, _ = problem.rates(member, label, steps)
            for m, name in enumerate(problem.mixes):
                keep = found[m] > 0
                yield batch.loc[keep, ["doc_id", "source", "n_tokens"]].assign(mix_name=name, rate=found[m][keep])[["mix_name", "doc_id", "source", "n_tokens", "rate"]]

    fitted = soft.mapInPandas(rated, "mix_name string, doc_id long, source string, n_tokens int, rate double")
    groups = max(1, -(-soft.count() // GROUP))
    group = F.pmod(F.xxhash64("doc_id", F.lit("group")), F.lit(groups))
    rounded = fitted.withColumn("group", group).groupBy("mix_name", "source", "group").applyInPandas(_whole, CHOSEN)
    picked = pin(rounded.where("repeats > 0"), "chosen")
    expected = picked.join(soft.select("doc_id", "member"), "doc_id").select("mix_name", F.posexplode("member").alias("_s", "part"), (F.col("n_tokens") * F.col("repeats")).alias("t"))
    names = F.array(*[F.lit(x) for x in problem.sources])
    expected = expected.groupBy("mix_name", F.get(names, F.col("_s")).alias("source")).agg(F.sum(F.col("t") * F.col("part")).alias("member_tokens"))
    return picked, shares(picked, targets, spark, expected), fit


def _whole(own: pd.DataFrame) -> pd.DataFrame:
    """Whole repeats of one group: largest texts first, what a text gets too much or too little is passed on in tokens."""
    own = own.sort_values(["n_tokens", "doc_id"], ascending=[False, True], ignore_index=True)
    base = np.floor(own["rate"].to_numpy() + 1e-9)
    part = np.maximum(own["rate"].to_numpy() - base, 0.0)
    carry, extra = 0.0, np.zeros(len(own))
    for k, size in enumerate(own["n_tokens"].to_numpy()):
        carry += part[k] * size
        if part[k] > 1e-9 and carry >= size / 2:
            extra[k] = 1
            carry -= size
    return pd.DataFrame({"mix_name": own["mix_name"], "doc_id": own["doc_id"], "source": own["source"], "n_tokens": own["n_tokens"], "repeats": (base + extra).astype(int)})


def shares(picked: DataFrame, targets: pd.DataFrame, spark: SparkSession, expected: DataFrame | None = None) -> DataFrame:
    """Per mix and listed source: target share among sources with documents, share reached by label and as expected from
    memberships, tokens, documents, most repeats."""
    listed = spark.createDataFrame(targets[["mix_name", "source", "weight", "max_repeats"]]) if len(targets) else spark.createDataFrame([], "mix_name string, source string, weight double, max_repeats int")
    sums = picked.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("repeats").alias("most_repeats"))
    expected = spark.createDataFrame([], "mix_name string, source string, member_tokens double") if expected is None else expected
    both = listed.join(sums, ["mix_name", "source"], "left").join(expected, ["mix_name", "source"], "left").na.fill(0, ["n_tokens", "n_docs", "most_repeats", "member_tokens"])
    total = both.groupBy("mix_name").agg(F.sum("n_tokens").alias("all_tokens"), F.sum("weight").alias("all_weight"), F.sum(F.when(F.col("n_docs") > 0, F.col("weight"))).alias("present"))
    out = both.join(total, "mix_name")
    target = F.when(F.col("n_docs") > 0, F.col("weight") / F.col("present")).otherwise(0.0)
    return out.select("mix_name", "source", F.round(F.col("weight") / F.col("all_weight"), 6).alias("listed_share"), F.round(target, 6).alias("target_share"), F.round(F.col("n_tokens") / F.greatest(F.col("all_tokens"), F.lit(1)), 6).alias("reached_share"), F.round(F.col("member_tokens") / F.greatest(F.col("all_tokens"), F.lit(1)), 6).alias("member_share"), "n_tokens", "n_docs", "most_repeats", "max_repeats")

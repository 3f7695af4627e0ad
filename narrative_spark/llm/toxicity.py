"""Toxic spans and document scores from a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bounded_arrow
from .sampling import held_out, sample_texts

TOKEN = re.compile(r"[^\W\d_]+")
SEGMENT = 128
#: Chains of a segment at most that are trained on together.
CHAINS = 2048
#: Texts that a feature must stand in to be tested. As many features pass by chance as one in all the tests.
LEAST_TEXTS = 4
MEMO = 100_000


def token_features(word: str) -> list[str]:
    """A word in lower case with its beginnings: stems count where endings vary."""
    return ["w" + word, *(f"p{word[:k]}" for k in (4, 5, 6) if len(word) > k)]


def unlike_texts(docs: list[tuple[list[str], int]]) -> list[tuple[list[str], int]]:
    """The sample without copies and near copies, whose rare words would look like evidence. Three least hashes of a
    text's word pairs are compared."""
    from zlib import crc32

    seen, kept = set(), []
    for words, y in docs:
        pairs = {f"{a} {b}".encode() for a, b in zip(words, words[1:])} or {" ".join(words).encode()}
        marks = {(k, min(crc32(x, k) for x in pairs)) for k in (1, 2, 3)}
        if not marks & seen:
            kept.append((words, y))
        seen |= marks
    return kept


def labelling_features(docs: list[tuple[list[str], int]]) -> set[str]:
    """Features whose documents are toxic far beyond chance: they turn document labels into token labels."""
    import math

    toxic, clean, n = Counter(), Counter(), Counter()
    for words, y in docs:
        n[y] += 1
        (toxic if y else clean).update({f for w in set(words) for f in token_features(w)})
    rate = n[1] / max(1, n[0] + n[1])
    if not 0 < rate < 1:
        return set()
    tested = {f: (k, k + clean[f]) for f, k in toxic.items() if k + clean[f] >= LEAST_TEXTS}
    limit = -math.log(max(2, len(tested)))
    return {f for f, (k, m) in tested.items() if k > 0.9 * m and k * math.log(rate) + math.log(math.comb(m, k)) < limit}


def chain_marginals(emission, transition, lengths):
    """``(marginals of state 1, log partition, pair expectations)`` of many chains at once.

    ``emission[k]`` is the score of state 1 over state 0 at a token; chains are rows, sorted by length, longest first.
    Messages are kept as log ratios of the two states, so that no length under- or overflows.
    """
    import numpy as np

    n, width = emission.shape
    (a, b), (c, d) = transition
    forward = np.zeros((n, width))
    log_z = np.zeros(n)
    ratio = emission[:, 0].copy()
    forward[:, 0] = ratio
    live_at = np.searchsorted(-lengths, -np.arange(width), side="left")
    for t in range(1, width):
        live = live_at[t]
        r = ratio[:live]
        to_1, to_0 = np.logaddexp(b, d + r), np.logaddexp(a, c + r)
        log_z[:live] += to_0
        ratio[:live] = emission[:live, t] + to_1 - to_0
        forward[:live, t] = ratio[:live]
    log_z += np.logaddexp(0, ratio)
    backward = np.zeros((n, width))
    for t in range(width - 2, -1, -1):
        live = live_at[t + 1]
        r = emission[:live, t + 1] + backward[:live, t + 1]
        backward[:live, t] = np.logaddexp(c, d + r) - np.logaddexp(a, b + r)
    return forward, backward, log_z


def sigmoid(x):
    import numpy as np

    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


class ToxicityModel:
    def __init__(self):
        self.weights: dict[str, float] = {}
        self.bias = -6.0
        self.transition = ((0.0, 0.0), (0.0, 0.0))
        self.score_weights = (-3.0, 0.0, 0.0, 0.0)
        self.memo: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def emission(self, word: str) -> float:
        word = word.lower()
        return self.bias + sum(self.weights.get(f, 0.0) for f in token_features(word))

    def emissions(self, words: list[str]):
        """Scores of a list of tokens; repeated tokens are looked up."""
        out, memo = [], self.memo
        for w in words:
            e = memo.get(w)
            if e is None:
                e = self.emission(w)
                if len(memo) < MEMO:
                    memo[w] = e
            out.append(e)
        return out

    def train(self, sample: list[tuple[str, int]], rounds: int = 30, rate: float = 0.5, ridge: float = 0.02) -> "ToxicityModel":
        """Maximise the conditional log-likelihood of the token labels by full-batch AdaGrad, then fit the score."""
        import numpy as np

        docs = [([w.lower() for w in TOKEN.findall(text)], int(y)) for text, y in sample]
        docs = unlike_texts(docs)
        seeds = labelling_features(docs)
        if not seeds:
            return self
        types: dict[str, int] = {}
        chains, gold = [], []
        flagged: dict[str, bool] = {}
        for words, y in docs:
            ids = [types.setdefault(w, len(types)) for w in words]
            hot = [False] * len(words)
            if y:
                hot = [flagged[w] if w in flagged else flagged.setdefault(w, any(f in seeds for f in token_features(w))) for w in words]
            for at in range(0, len(ids), SEGMENT):
                chains.append(ids[at : at + SEGMENT])
                gold.append(hot[at : at + SEGMENT])
        order = sorted(range(len(chains)), key=lambda k: -len(chains[k]))
        chains, gold = [chains[k] for k in order], [gold[k] for k in order]
        lengths = np.array(list(map(len, chains)))
        inside = np.arange(SEGMENT)[None, :] < lengths[:, None]
        grid, y = np.zeros(inside.shape, dtype=np.int32), np.zeros(inside.shape, dtype=np.int8)
        grid[inside] = np.concatenate([np.asarray(c, dtype=np.int32) for c in chains])
        y[inside] = np.concatenate([np.asarray(g, dtype=np.int8) for g in gold])
        names: dict[str, int] = {}
        common = Counter(f for w in types for f in token_features(w))
        links = [(t, names.setdefault(f, len(names))) for w, t in types.items() for f in token_features(w) if common[f] > 1 or f in seeds]
        rows, cols = np.array([x for x, _ in links]), np.array([x for _, x in links])
        theta, bias, trans = np.zeros(len(names)), -4.0, np.zeros((2, 2))
        trans[0, 0] = 1.0
        past, past_b, past_t = np.full(len(names), 1e-6), 1e-6, np.full((2, 2), 1e-6)
        pairs = inside[:, 1:]
        seen = np.array([[((y[:, :-1] == p) & (y[:, 1:] == q) & pairs).sum() for q in (0, 1)] for p in (0, 1)], dtype=float)
        parts = [slice(at, at + CHAINS) for at in range(0, len(chains), CHAINS)]
        for _ in range(rounds):
            by_type = bias + np.bincount(rows, weights=theta[cols], minlength=len(types))
            g_type, expected = np.zeros(len(types)), np.zeros((2, 2))
            for part in parts:  # some chains at a time: the messages of all are never held together
                here, own = inside[part], grid[part]
                e = by_type[own] * here
                f, b, _z = chain_marginals(e, trans, lengths[part])
                p = sigmoid(f + b) * here
                # expected transitions: of neighbouring states given both messages
                left, right = f[:, :-1], e[:, 1:] + b[:, 1:]
                s = [[trans[i, j] + i * left + j * right for j in (0, 1)] for i in (0, 1)]
                z = np.logaddexp(np.logaddexp(s[0][0], s[0][1]), np.logaddexp(s[1][0], s[1][1]))
                expected += np.array([[(np.exp(s[i][j] - z) * pairs[part]).sum() for j in (0, 1)] for i in (0, 1)])
                g_type += np.bincount(own[here], weights=(y[part] - p)[here], minlength=len(types))
            g = np.bincount(cols, weights=g_type[rows], minlength=len(names)) - ridge * theta
            g_b, g_t = g_type.sum(), seen - expected
            past, past_b, past_t = past + g * g, past_b + g_b * g_b, past_t + g_t * g_t
            theta, bias, trans = theta + rate * g / np.sqrt(past), bias + rate * g_b / past_b**0.5, trans + 0.2 * g_t / np.sqrt(past_t)
        keep = np.flatnonzero(np.abs(theta) > 1e-3)
        listed = list(names)
        self.weights = {listed[k]: float(theta[k]) for k in keep}
        self.bias, self.transition = float(bias), tuple(map(tuple, trans.tolist()))
        self._fit_score([t for t, _ in sample], np.array([float(v) for _, v in sample]))
        return self

    def _fit_score(self, texts: list[str], y) -> None:
        """Logistic weights of a document's aggregates; classes have the weights of the sample."""
        import numpy as np

        x = np.column_stack([np.ones(len(texts)), *self.aggregates(texts)[:3]])
        loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + 5e-3 * (w @ w)
        w = np.zeros(4)
        for _ in range(50):  # Newton's method; a step is halved until it helps
            p = sigmoid(x @ w)
            h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(4)
            step, now = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w), loss(w)
            while np.abs(step).max() > 1e-6 and loss(w + step) > now:
                step = step / 2
            w = w + step
            if np.abs(step).max() <= 1e-6:
                break
        self.score_weights = tuple(w.tolist())

    def aggregates(self, texts: list[str]):
        """Per text: logs of the expected number of toxic tokens and of all, the greatest log odds, and marginals."""
        import numpy as np

        words = [TOKEN.findall(t) for t in texts]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        expected, greatest = np.zeros(len(texts)), np.full(len(texts), -20.0)
        marginals: list = [None] * len(texts)
        # chains of similar length side by side: a long text doesn't widen the others' table
        at = 0
        while at < len(order) and sizes[order[at]]:
            width = int(sizes[order[at]])
            end = at + 1
            while end < len(order) and sizes[order[end]] and 2 * sizes[order[end]] >= width and (end - at) * width < 500_000:
                end += 1
            own = order[at:end]
            e = np.zeros((len(own), width))
            for k, d in enumerate(own.tolist()):
                e[k, : sizes[d]] = self.emissions(words[d])
            f, b, _ = chain_marginals(e, self.transition, sizes[own])
            odds = np.where(np.arange(width)[None, :] < sizes[own][:, None], f + b, -60.0)
            p = sigmoid(odds)
            expected[own] = np.where(odds > -60.0, p, 0.0).sum(axis=1)
            greatest[own] = odds.max(axis=1)
            for k, d in enumerate(own.tolist()):
                if greatest[d] > 0:
                    marginals[d] = p[k, : sizes[d]]
            at = end
        return np.log(expected + 1e-4), np.log(sizes + 1.0), np.clip(greatest, -20, 20), marginals

    def score(self, texts: list[str | None]) -> list[tuple[float, list[dict]]]:
        import numpy as np

        texts = [t or "" for t in texts]
        expected, length, greatest, marginals = self.aggregates(texts)
        w = self.score_weights
        scores = sigmoid(w[0] + w[1] * expected + w[2] * length + w[3] * greatest)
        spans: list[list[dict]] = []
        for text, p in zip(texts, marginals):
            found: list[dict] = []
            if p is not None:
                hot = set(np.flatnonzero(p > 0.5).tolist())
                for k, m in enumerate(TOKEN.finditer(text)):
                    if k not in hot:
                        continue
                    if k - 1 in hot and found:  # neighbours make one span
                        found[-1]["end"], found[-1]["p"] = m.end(), max(found[-1]["p"], float(p[k]))
                    else:
                        found.append({"start": m.start(), "end": m.end(), "p": float(p[k])})
            spans.append(found)
        return list(zip(scores.tolist(), spans))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 1000, most_bytes: int = 12_000) -> ToxicityModel:
    """A model from up to ``per_label`` toxic and as many other texts, short ones first and pieces of about ``most_bytes``
    of longer ones; both bound the sample.

    Only rows of ``docs`` that aren't held out are learnt from. A document with several labels counts as toxic if one says so.
    Without labels of both kinds, the model knows no toxic word and scores all texts low and alike.
    """
    one = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label")).join(docs.select("doc_id"), "doc_id", "left_semi")
    return ToxicityModel().train(sample_texts(docs, one, per_label, most_bytes))


SPANS = "array<struct<start:int,end:int,p:double>>"


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, model: ToxicityModel | None = None) -> DataFrame:
    """``(doc_id, held_out, score, predicted, spans)``, one per input row.

    Whole texts are tagged; forward-backward marginals over 0.5 give ``spans`` (character offsets, neighbours joined).
    ``score`` is a logistic of a text's expected number of toxic tokens, its length and its most certain token. Null, empty and
    wordless texts have the score of no evidence. Equal texts have equal scores; extra columns are ignored.
    """
    spark = docs.sparkSession
    bounded_arrow(spark)
    shared = spark.sparkContext.broadcast(model or fit(docs, labels))  # bounded by fit's parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            found = shared.value.score(batch.column(2).to_pylist())
            scores = [s for s, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([x for _, x in found], kind)],
                names=["doc_id", "held_out", "score", "predicted", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, spans {SPANS}")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns."""
    spark = docs.sparkSession
    bounded_arrow(spark)
    shared = spark.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([s < threshold for s, _ in shared.value.score(batch.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

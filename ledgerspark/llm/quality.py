"""Quality rules: fixed rules on document statistics, then gradient-boosted trees with monotonic constraints.

The statistics of a text are computed where its row lies, without a shuffle. The trees are fitted on the driver, over
a bounded sample of labelled rows (FIT_ROWS), flattened into numpy node arrays and applied batch by batch.

Defined results: a null or empty text has no words, so base_failed is true and kept false. Repeated rows each get the
same result. Labels that are null are left out; without usable labels of both kinds every row that passes the base
rules is kept. An empty table gives an empty table. Of the input's columns only doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, map_arrow

#: Labelled rows at most that the trees are fitted on: those with the smallest hashes of doc_id.
FIT_ROWS = 20_000
SPACES, SYMBOLS, MIN_WORDS, MAX_REPEAT_PERCENT = " \t\n\x0b\x0c\r", "#*$%&|<>", 50, 50
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: The trees' features, with the sign that the verdict may move in as the feature grows (0: either).
FEATURES = {"log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "bang_share": -1, "distinct_share": 0, "line_words": 0, "stop_share": 0}
_UPPER = bytes(range(65, 91))


def text_stats(text: str | None) -> tuple[list[int], list[float]]:
    """The five base counts of COUNTS, and the values of FEATURES."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: exactly the six ASCII white spaces
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeat = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        times, hit = Counter(windows), bytearray(n)
        for i, w in enumerate(windows):
            if times[w] > 1:
                hit[i : i + 3] = b"\1\1\1"
        repeat = sum(hit)
    letters = max(1, word_chars)
    one = max(1, n)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    short = sum(1 for w in words if len(w) <= 3)
    return [n, word_chars, symbols, dup, repeat], [np.log1p(n), word_chars / one, symbols / letters, dup / max(1, lines), repeat / one, upper / letters, text.count("!") / letters, len(set(words)) / one, n / max(1, lines), short / one]


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


@dataclass
class Trees:
    """Trees as node arrays. Row of a tree's root: roots[i]; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of x; all rows and trees step down one level at a time."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 20, ridge: float = 1.0) -> Trees:
    """Boosts histogram trees on the logistic loss. A split on a feature with a sign is taken only if its leaves are in
    that order, and both sides keep to their side of the middle from then on, so that the sum is monotonic in it."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots, pred = [], np.full(len(y), base)
    if not 0 < y.sum() < len(y):
        trees = 0
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if trees else np.zeros(0) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1) if trees else None

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, level: int) -> int:
        at = len(nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        own = float(np.clip(-total_g / (total_h + ridge), low, high))
        nodes.append([0, 0.0, at, at, own * rate])
        best: tuple | None = None
        if level < depth and len(rows) >= 2 * least:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                c = code[rows, f]
                n, sg, sh = (np.cumsum(np.bincount(c, w, len(e) + 1))[:-1] for w in (None, g[rows], h[rows]))
                lv, rv = np.clip(-sg / (sh + ridge), low, high), np.clip(-(total_g - sg) / (total_h - sh + ridge), low, high)
                gain = -(sg * lv + (sh + ridge) * lv**2 / 2 + (total_g - sg) * rv + (total_h - sh + ridge) * rv**2 / 2)
                gain = np.where((n >= least) & (len(rows) - n >= least) & (signs[f] * (rv - lv) >= 0), gain, -np.inf)
                k = int(gain.argmax())
                if gain[k] > -(total_g * own + (total_h + ridge) * own**2 / 2) + 1e-6 and (best is None or gain[k] > best[0]):
                    best = (gain[k], f, k, lv[k], rv[k])
        if best:
            _, f, k, lv, rv = best
            mid, s = (lv + rv) / 2, signs[f]
            goes = code[rows, f] <= k
            left = grow(rows[goes], g, h, mid if s < 0 else low, mid if s > 0 else high, level + 1)
            right = grow(rows[~goes], g, h, mid if s > 0 else low, mid if s < 0 else high, level + 1)
            nodes[at] = [f, edges[f][k], left, right, 0.0]
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-pred))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), -np.inf, np.inf, 0))
        a = np.array(nodes)
        pred += Trees(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots[-1:]), depth, 0.0).score(x)
    a = np.array(nodes).reshape(-1, 5)
    return Trees(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots, dtype=int), depth, base if trees else max(base, 0.0) if len(y) else 0.0)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Trees:
    """Fits the trees on at most `rows` labelled documents; both the join's broadcast side and what is collected have that bound."""
    sample = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    def stats(c: dict) -> dict:
        return {"x": [text_stats(t)[1] for t in c["text"].to_pylist()], "quality": c["quality"], "doc_id": c["doc_id"]}

    found = map_arrow(doc_text(docs).join(F.broadcast(sample), "doc_id"), stats, "x array<double>, quality int, doc_id long").orderBy("doc_id", "x").limit(rows).toPandas()
    x = np.array(found["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, found["quality"].to_numpy(dtype=float), list(FEATURES.values()))


def quality(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, the five counts, base_failed, score (log odds of good quality) and kept, for every row."""

    def judge(c: dict) -> dict:
        stats = [text_stats(t) for t in c["text"].to_pylist()]
        x = np.array([s[1] for s in stats], dtype=float).reshape(-1, len(FEATURES))
        counts = np.array([s[0] for s in stats], dtype=np.int64).reshape(-1, len(COUNTS))
        failed = np.array([base_failed(a[0], a[4]) for a in counts], dtype=bool)
        score = model.score(x)
        return {"doc_id": c["doc_id"], **{k: counts[:, i] for i, k in enumerate(COUNTS)}, "base_failed": failed, "score": score, "kept": ~failed & (score >= 0)}

    return map_arrow(doc_text(docs), judge, "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, score double, kept boolean")


def keep(docs: DataFrame, model: Trees) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep; one pass, no join."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("boolean")
    def kept(text):
        import pandas as pd

        stats = [text_stats(t) for t in text]
        x = np.array([s[1] for s in stats], dtype=float).reshape(-1, len(FEATURES))
        failed = np.array([base_failed(s[0][0], s[0][4]) for s in stats], dtype=bool)
        return pd.Series(~failed & (model.score(x) >= 0))

    return docs.filter(kept(F.col("text").cast("string")))

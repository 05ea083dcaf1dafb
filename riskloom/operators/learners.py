"""Small numpy learners for hyper-parameter search, where many fits run side by
side, several per task (``search.py``).

``BoostedTrees`` grows second-order trees on binned features; tree t depends only
on the seed and the trees before it, so the first 100 trees of a fit of 300 are the fit of
100. ``EmbeddingNetwork`` is a feed-forward network with one embedding per
categorical column, trained in mini-batches. Both are plain functions of arrays:
``prepare`` (from arrays) or ``prepare_from`` (from a frame), ``fit`` (one setting), ``scores`` (any rows); ``inputs``
of rows are made once for ``scores_of`` many models.

``fit_packed`` fits on any number of rows: ``packed`` rows lie in a file mapped into memory, what a fit
keeps per row lies in ``scratch`` arrays, and rows go through memory in blocks or mini-batches. In memory stay 24 bytes a row:
which rows are used, their labels, and the network's order of an epoch."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


BLOCK = 8192  # rows that go down a tree, or through a network, at a time
ROWS = 1 << 16  # rows of a fit whose histograms are counted at a time


class BoostedTrees:
    """Binary log-loss; a node is split if its gain exceeds ``gamma`` (checked while
    growing). Parameters by their usual names: n_estimators, max_depth,
    learning_rate, subsample, colsample_bytree, gamma. Positive rows weigh
    negatives / positives. Missing values go to the lowest bin."""

    staged = "n_estimators"

    def __init__(self, bins: int = 64, l2: float = 1.0, min_child_weight: float = 1.0):
        self.bins, self.l2, self.least = bins, l2, min_child_weight

    def prepare(self, x: np.ndarray, cols: list[str]) -> None:
        probs = np.linspace(0, 1, self.bins + 1)[1:-1]
        known = [c[~np.isnan(c)] for c in x.T]
        self.cuts = [np.unique(np.quantile(c, probs, method="lower")) if len(c) else np.zeros(0) for c in known]

    def prepare_from(self, rows, cols: list[str]) -> None:
        """``prepare`` from a frame with an array column ``x``: exact quantiles of all its rows."""
        from riskloom.operators.ranking import exact_quantiles_of
        names = [f"c{j}" for j in range(len(cols))]
        probs = np.linspace(0, 1, self.bins + 1)[1:-1].tolist()
        found = exact_quantiles_of(rows.select(*[rows["x"][j].alias(c) for j, c in enumerate(names)]), {c: probs for c in names}, lower=True)
        self.cuts = [np.unique([v for v in found[c] if v is not None]).astype(float) for c in names]

    def cost(self, params: dict) -> float:
        """Work of a fit, against others of the same rows."""
        return params["n_estimators"] * (params.get("max_depth", 6) + 1) * params.get("colsample_bytree", 1.0)

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for j, cuts in enumerate(self.cuts):
            out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(cuts, x[:, j], side="left"))
        return out

    def _tree(self, codes: np.ndarray, g: np.ndarray, h: np.ndarray, node: np.ndarray, spans: list[tuple[int, int]], columns: np.ndarray, depth: int, gamma: float, rate: float) -> tuple:
        """A tree from ``codes`` (column by row); ``node`` is left with the leaf of every row. Rows of no
        weight add nothing. A level is one pass over the rows, span by span."""
        size, b = 2 ** (depth + 1) - 1, self.bins + 1
        feature, cut, value = np.full(size, -1, np.int16), np.zeros(size, np.uint8), np.zeros(size, np.float32)
        for level in range(depth + 1):
            first, width = 2 ** level - 1, 2 ** level
            total_g, total_h = np.zeros(width), np.zeros(width)
            left_g, left_h = (np.zeros((width, len(columns), b if level < depth else 0)) for _ in range(2))
            for lo, hi in spans:
                here, rows = node[lo:hi], slice(None)
                if level:  # rows of nodes that were split go down; the others have their leaf
                    by = feature[here]
                    rows = np.flatnonzero(by >= 0)
                    at = here[rows]
                    at = 2 * at + 1 + (codes[by[rows], lo + rows] > cut[at])
                    here[rows] = at
                    here = at
                    if len(rows) == hi - lo:
                        rows = slice(None)
                own, own_g, own_h = here.astype(np.int64) - first, g[lo:hi][rows], h[lo:hi][rows]
                total_g += np.bincount(own, own_g, width)
                total_h += np.bincount(own, own_h, width)
                if level == depth:
                    continue
                own *= b
                for j, column in enumerate(columns):
                    at = own + codes[column, lo:hi][rows]
                    left_g[:, j] += np.bincount(at, own_g, width * b).reshape(-1, b)
                    left_h[:, j] += np.bincount(at, own_h, width * b).reshape(-1, b)
            names = np.flatnonzero(total_h > 0)
            total_g, total_h = total_g[names], total_h[names]
            value[first + names] = -rate * total_g / (total_h + self.l2)
            if level == depth:
                break
            left_g, left_h = left_g[names].cumsum(2), left_h[names].cumsum(2)
            right_g, right_h = total_g[:, None, None] - left_g, total_h[:, None, None] - left_h
            gain = left_g ** 2 / (left_h + self.l2) + right_g ** 2 / (right_h + self.l2) - (total_g ** 2 / (total_h + self.l2))[:, None, None]
            gain[(left_h < self.least) | (right_h < self.least)] = -np.inf
            flat = gain.reshape(len(names), -1)
            best = flat.argmax(1)
            split = flat[np.arange(len(names)), best] > max(gamma, 1e-9)
            if not split.any():
                break
            f, c = np.divmod(best, b)
            feature[first + names[split]], cut[first + names[split]] = columns[f[split]], c[split]
        return feature, cut, value

    @staticmethod
    def _leaf_values(tree: tuple, codes: np.ndarray) -> np.ndarray:
        """Leaves are drawn down to the last level, so that every row takes as many steps; rows go by blocks that stay in the cache."""
        feature, cut, value = (a.copy() for a in tree)
        depth = len(feature).bit_length() - 1
        for level in range(depth):
            leaf = np.arange(2 ** level - 1, 2 ** (level + 1) - 1)
            leaf = leaf[feature[leaf] < 0]
            value[2 * leaf + 1] = value[leaf]
        cut[feature < 0] = 255  # no code is above: to the left
        column, cut = np.maximum(feature, 0).astype(np.int64), cut.astype(np.int64)
        out, width = np.empty(len(codes)), codes.shape[1]
        for lo in range(0, len(codes), BLOCK):
            block = np.ascontiguousarray(codes[lo:lo + BLOCK])
            flat, start = block.ravel(), np.arange(len(block)) * width
            node = np.zeros(len(block), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (flat[start + column[node]] > cut[node])
            out[lo:lo + BLOCK] = value[node]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, params: dict, seed: int) -> list[tuple]:
        return self._fit(np.ascontiguousarray(self.codes(x).T), y, params, seed)

    def packed(self, x: np.ndarray) -> np.ndarray:
        """Bytes of the rows, as ``fit_packed`` takes them."""
        return self.codes(x)

    def fit_packed(self, packed: np.ndarray, y: np.ndarray, use: np.ndarray, params: dict, seed: int, rows: int = ROWS, scratch=np.zeros) -> list[tuple]:
        """``fit`` on the rows ``use``, of which ``rows`` are in memory at a time."""
        codes = scratch((packed.shape[1], len(use)), np.uint8)
        for lo in range(0, len(use), rows):
            codes[:, lo:lo + rows] = packed[use[lo:lo + rows]].T
        return self._fit(codes, y[use], params, seed, rows, scratch)

    def _fit(self, codes: np.ndarray, y: np.ndarray, params: dict, seed: int, rows: int = ROWS, scratch=np.zeros) -> list[tuple]:
        n, trees = len(y), []
        spans = [(lo, min(lo + rows, n)) for lo in range(0, n, rows)]
        margin, g, h, node = scratch(n, float), scratch(n, float), scratch(n, float), scratch(n, np.int32)
        positive = max(1.0, (y == 0).sum()) / max(1.0, (y == 1).sum())
        for t in range(params["n_estimators"]):
            rng = np.random.default_rng([seed, t])
            for lo, hi in spans:
                p, label = sigmoid(margin[lo:hi]), y[lo:hi]
                weight = np.where(label == 1, positive, 1.0)
                use = rng.random(hi - lo) < params.get("subsample", 1.0)
                g[lo:hi], h[lo:hi] = weight * (p - label) * use, weight * np.maximum(p * (1 - p), 1e-16) * use
                node[lo:hi] = 0
            columns = np.sort(rng.permutation(len(codes))[:max(1, round(params.get("colsample_bytree", 1.0) * len(codes)))])
            tree = self._tree(codes, g, h, node, spans, columns, params.get("max_depth", 6), params.get("gamma", 0.0), params.get("learning_rate", 0.3))
            for lo, hi in spans:
                margin[lo:hi] += tree[2][node[lo:hi]]
            trees.append(tree)
        return trees

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return self.codes(x)

    def scores(self, trees: list[tuple], x: np.ndarray, stages: list[int]) -> list[np.ndarray]:
        return self.scores_of(trees, self.inputs(x), stages)

    def scores_of(self, trees: list[tuple], codes: np.ndarray, stages: list[int]) -> list[np.ndarray]:
        """Probabilities by the first ``stage`` trees, for each stage."""
        margin, out = np.zeros(len(codes)), {}
        for t, tree in enumerate(trees, 1):
            margin += self._leaf_values(tree, codes)
            if t in stages:
                out[t] = sigmoid(margin)
        return [out[s] for s in stages]


ACTIVATIONS = ("relu", "leaky_relu", "tanh")


class EmbeddingNetwork:
    """Numeric columns (standardised by all rows given) beside embeddings of
    min(50, (cardinality + 1) // 2) numbers for categorical ones, hidden layers
    with activation and dropout, one output. Parameters: hidden_dims, dropout,
    lr, optimizer_name (adam, sgd), activation_name, n_epochs, batch_size. A value
    that these lack has the embedding zero; a missing number is the mean."""

    staged = None

    def __init__(self, categorical: list[str]):
        self.categorical = list(categorical)

    def prepare(self, x: np.ndarray, cols: list[str]) -> None:
        self.cat = [i for i, c in enumerate(cols) if c in self.categorical]
        self.num = [i for i in range(len(cols)) if i not in self.cat]
        self.values = [np.unique(x[:, i][~np.isnan(x[:, i])]) for i in self.cat]
        self.mean = np.nan_to_num(np.nanmean(x[:, self.num], axis=0)) if len(x) else np.zeros(len(self.num))
        std = np.nan_to_num(np.nanstd(x[:, self.num], axis=0)) if len(x) else np.zeros(len(self.num))
        self.std = np.where(std > 0, std, 1.0)

    def prepare_from(self, rows, cols: list[str]) -> None:
        """``prepare`` from a frame with an array column ``x``. Means and deviations keep 12 digits: those after hang on the order of the sum."""
        from pyspark.sql import functions as F
        self.cat = [i for i, c in enumerate(cols) if c in self.categorical]
        self.num = [i for i in range(len(cols)) if i not in self.cat]
        of = lambda i: F.nanvl(rows["x"][i], F.lit(None).cast("double"))
        row = rows.agg(F.struct(*[F.avg(of(i)).alias(f"m{i}") for i in self.num], F.lit(0).alias("_")).alias("m"),
                       F.struct(*[F.stddev_pop(of(i)).alias(f"s{i}") for i in self.num], F.lit(0).alias("_")).alias("s"),
                       *[F.collect_set(of(i)).alias(f"v{i}") for i in self.cat]).first()  # each value has an embedding in every model
        digits = lambda v: np.nan_to_num(np.array([float(f"{x:.12g}") if x is not None else 0.0 for x in v]))
        self.values = [np.unique(np.array(row[f"v{i}"], float)) for i in self.cat]
        self.mean, std = digits(row["m"][:-1]), digits(row["s"][:-1])
        self.std = np.where(std > 0, std, 1.0)

    def cost(self, params: dict) -> float:
        """Work of a fit, against others of the same rows."""
        sizes = [len(self.num) + sum(min(50, (len(v) + 1) // 2) for v in self.values), *params["hidden_dims"], 1]
        return params.get("n_epochs", 5) * sum(a * b for a, b in zip(sizes, sizes[1:]))

    def packed(self, x: np.ndarray) -> np.ndarray:
        """Bytes of the rows, as ``fit_packed`` takes them."""
        num, cats = self.inputs(x)
        codes = np.stack(cats, 1).astype(np.int32) if cats else np.zeros((len(x), 0), np.int32)
        return np.hstack([np.ascontiguousarray(num, float).view(np.uint8).reshape(len(x), 8 * len(self.num)), codes.view(np.uint8).reshape(len(x), 4 * len(cats))])

    def _unpacked(self, packed: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        at, n = 8 * len(self.num), len(packed)
        num = np.frombuffer(packed[:, :at].tobytes(), float).reshape(n, len(self.num))
        cats = np.frombuffer(packed[:, at:].tobytes(), np.int32).reshape(n, len(self.cat))
        return num, list(np.ascontiguousarray(cats.T))

    def _inputs(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        num = np.nan_to_num((x[:, self.num] - self.mean) / self.std)
        cats = []
        for i, known in zip(self.cat, self.values):
            at = np.minimum(np.searchsorted(known, x[:, i]), max(0, len(known) - 1))
            cats.append(np.where(known[at] == x[:, i], at + 1, 0) if len(known) else np.zeros(len(x), np.int64))
        return num, cats

    inputs = _inputs

    @staticmethod
    def _value(name: str, z: np.ndarray) -> np.ndarray:
        return np.maximum(z, 0, out=z) if name == "relu" else np.maximum(z, 0.01 * z, out=z) if name == "leaky_relu" else np.tanh(z, out=z)

    @staticmethod
    def _act(name: str, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value and derivative."""
        if name == "relu":
            return np.maximum(z, 0), (z > 0).astype(float)
        if name == "leaky_relu":
            return np.where(z > 0, z, 0.01 * z), np.where(z > 0, 1.0, 0.01)
        if name == "tanh":
            t = np.tanh(z)
            return t, 1 - t * t
        raise ValueError(f"activation must be one of {ACTIVATIONS}, got {name!r}")

    def _start(self, params: dict, rng: np.random.Generator) -> dict[str, np.ndarray]:
        out = {}
        width = len(self.num)
        for j, known in enumerate(self.values):
            dim = min(50, (len(known) + 1) // 2)
            out[f"e{j}"] = rng.normal(size=(len(known) + 1, dim))
            out[f"e{j}"][0] = 0.0
            width += dim
        for i, size in enumerate([*params["hidden_dims"], 1]):
            bound = 1 / np.sqrt(max(1, width))
            out[f"w{i}"], out[f"b{i}"] = rng.uniform(-bound, bound, (width, size)), rng.uniform(-bound, bound, size)
            width = size
        return out

    def _forward(self, model: dict, num: np.ndarray, cats: list[np.ndarray], params: dict, rng=None) -> tuple[np.ndarray, list]:
        a = np.hstack([num, *(model[f"e{j}"][c] for j, c in enumerate(cats))])
        layers, last = [], len(params["hidden_dims"])
        for i in range(last):
            z, slope = self._act(params.get("activation_name", "relu"), a @ model[f"w{i}"] + model[f"b{i}"])
            if rng is not None and params.get("dropout", 0.0) > 0:
                mask = (rng.random(z.shape) >= params["dropout"]) / (1 - params["dropout"])
                z, slope = z * mask, slope * mask
            layers.append((a, slope))
            a = z
        layers.append((a, None))
        return (a @ model[f"w{last}"] + model[f"b{last}"])[:, 0], layers

    def gradients(self, model: dict, num: np.ndarray, cats: list[np.ndarray], y: np.ndarray, positive: float, params: dict, rng=None) -> dict[str, np.ndarray]:
        """Of the mean log-loss with positive rows weighted ``positive``."""
        out, layers = self._forward(model, num, cats, params, rng)
        p = sigmoid(out)
        delta = (np.where(y == 1, positive, 1.0) * (p - y) / len(y))[:, None]
        grad = {}
        for i in range(len(layers) - 1, -1, -1):
            a = layers[i][0]
            grad[f"w{i}"], grad[f"b{i}"] = a.T @ delta, delta.sum(0)
            delta = delta @ model[f"w{i}"].T
            if i:
                delta *= layers[i - 1][1]
        at = num.shape[1]
        for j, c in enumerate(cats):
            table = model[f"e{j}"]
            grad[f"e{j}"] = np.zeros_like(table)
            np.add.at(grad[f"e{j}"], c, delta[:, at:at + table.shape[1]])
            grad[f"e{j}"][0] = 0.0
            at += table.shape[1]
        return grad

    def fit(self, x: np.ndarray, y: np.ndarray, params: dict, seed: int) -> dict:
        num, cats = self.inputs(x)
        return self._fit(lambda rows: (num[rows], [c[rows] for c in cats]), y, params, seed)

    def fit_packed(self, packed: np.ndarray, y: np.ndarray, use: np.ndarray, params: dict, seed: int, rows: int = ROWS, scratch=np.zeros) -> dict:
        """``fit`` on the rows ``use``; a mini-batch of them is in memory at a time."""
        return self._fit(lambda at: self._unpacked(packed[use[at]]), y[use], params, seed)

    def _fit(self, taken, y: np.ndarray, params: dict, seed: int) -> dict:
        rng = np.random.default_rng(seed)
        model = self._start(params, rng)
        positive = max(1.0, (y == 0).sum()) / max(1.0, (y == 1).sum())
        size, lr, adam = params.get("batch_size", 64), params.get("lr", 1e-3), params.get("optimizer_name", "adam")
        if adam not in ("adam", "sgd"):
            raise ValueError(f"optimizer must be adam|sgd, got {adam!r}")
        # all weights lie in one vector, so that a step is a few operations in place
        flat, at = np.concatenate([t.ravel() for t in model.values()]), np.cumsum([t.size for t in model.values()])[:-1]
        model = {k: part.reshape(t.shape) for (k, t), part in zip(model.items(), np.split(flat, at))}
        g, by, root, m, v = (np.zeros_like(flat) for _ in range(5))
        step = 0
        for _ in range(params.get("n_epochs", 5)):
            order = rng.permutation(len(y))
            for at in range(0, len(order), size):
                rows = order[at:at + size]
                grad = self.gradients(model, *taken(rows), y[rows], positive, params, rng)
                step += 1
                np.concatenate([grad[k].ravel() for k in model], out=g)
                if adam == "sgd":
                    flat -= np.multiply(g, lr, out=by)
                    continue
                m *= 0.9
                m += np.multiply(g, 0.1, out=by)
                v *= 0.999
                np.multiply(g, 0.001, out=by)
                v += np.multiply(by, g, out=by)
                np.sqrt(np.divide(v, 1 - 0.999 ** step, out=root), out=root)
                root += 1e-8
                np.multiply(np.divide(m, 1 - 0.9 ** step, out=by), lr, out=by)
                flat -= np.divide(by, root, out=by)
        return {"weights": {k: t.astype(np.float32) for k, t in model.items()}, "params": params}

    def scores(self, model: dict, x: np.ndarray, stages: list) -> list[np.ndarray]:
        return self.scores_of(model, self.inputs(x), stages)

    def scores_of(self, model: dict, inputs: tuple[np.ndarray, list[np.ndarray]], stages: list) -> list[np.ndarray]:
        (num, cats), params = inputs, model["params"]
        weights = {k: t.astype(float) for k, t in model["weights"].items()}
        last, name, out = len(params["hidden_dims"]), params.get("activation_name", "relu"), np.empty(len(num))
        for lo in range(0, len(num), BLOCK):  # layers of a block stay in the cache; no slopes are needed
            a = np.hstack([num[lo:lo + BLOCK], *(weights[f"e{j}"][c[lo:lo + BLOCK]] for j, c in enumerate(cats))])
            for i in range(last):
                a = a @ weights[f"w{i}"]
                a += weights[f"b{i}"]
                a = self._value(name, a)
            out[lo:lo + BLOCK] = (a @ weights[f"w{last}"] + weights[f"b{last}"])[:, 0]
        return [sigmoid(out)]

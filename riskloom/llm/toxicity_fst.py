"""Toxicity scores from a weighted finite-state grammar over clauses.

Words become symbols: insult (a learned lexicon of words and of word stems,
each with a weight), harm, intent, target, negation, reported speech, other.
Four transducers rewrite the symbols of a clause in turn: negation turns an
insult in its scope into a negated one, reported speech into a reported one,
threat recognises intent + harm + target, target turns an insult near a person
into an aimed one. They are composed into a single transducer, whose outputs on
a clause are its matches; a text's score is a logistic function of the weights
of its matched clauses. Texts without a match get the base score.

Lexicon and weights are learned from at most about ``SAMPLE_DOCS`` labelled
rows per class, chosen by a hash of doc_id; scoring reads all rows and whole
texts. With no labelled row (or a single class) the lexicon is empty and the
prior weights hold.

Null and empty texts get the base score. Repeated rows are scored row by row,
extra columns are ignored, labels without a document or with a null value are
not used, several labels of one document count each. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm import segments as S
from riskloom.llm.rowwise import add_from_text

SAMPLE_DOCS = 4000
LEXICON = 20_000
STEMS = (4, 5, 6)
MIN_TOXIC_DOCS = 3
MIN_EVIDENCE = 15.0
THRESHOLD = 0.3

# Closed word classes of the grammar, in four languages.
TARGETS = """you your yours yourself he him his she her they them their we us people everyone
du dich dir dein deine ihr euch sie er ihn tu te toi ton ta vous votre vos il elle ils elles lui
tú usted ustedes vosotros él ella ellos ellas""".split()
NEGATIONS = """not no never nobody nothing isn wasn aren don doesn didn won cannot
nicht kein keine nie niemals pas jamais aucun aucune nunca jamás ningún ninguna""".split()
REPORTED = """said says say saying wrote writes quoted quotes quote called reported claims claimed according
sagte sagt schrieb zitiert laut dit écrit selon cité dijo dice escribió según citó""".split()
INTENTS = "will would going gonna want should must hope werde wirst soll vais veux voy quiero".split()
HARMS = """kill killed hurt beat destroy murder shoot stab burn die töten schlagen umbringen
tuer frapper brûler mourir matar golpear quemar morir""".split()

OTHER, END, SKIP, INSULT, HARM, INTENT, TARGET, NEGATION, REPORT = range(9)
# Outputs of the grammar.
AIMED, NEGATED, QUOTED, THREAT = 10, 11, 12, 13
NEGATION_SCOPE, TARGET_SCOPE = 3, 4


class Transducer:
    """Deterministic: ``step(state, symbol) -> (state, output)``, start state 0."""

    def __init__(self, step, start=0):
        self.step, self.start = step, start

    def then(self, other: "Transducer") -> "Transducer":
        """Composition: this one's output is the other's input. Arcs are kept once found."""
        arcs: dict = {}

        def step(state, symbol):
            got = arcs.get((state, symbol))
            if got is None:
                a, mid = self.step(state[0], symbol)
                b, out = other.step(state[1], mid)
                got = arcs[state, symbol] = ((a, b), out)
            return got
        return Transducer(step, (self.start, other.start))


def _negation(scope, symbol):
    if symbol == NEGATION:
        return NEGATION_SCOPE, OTHER
    left = max(0, scope - 1)
    if scope and symbol in (INSULT, HARM):
        return left, NEGATED if symbol == INSULT else OTHER
    return left, symbol


def _reported(inside, symbol):
    if symbol == REPORT:
        return 1, OTHER
    if inside and symbol in (INSULT, HARM):
        return 1, QUOTED if symbol == INSULT else OTHER
    return inside, symbol


def _threat(state, symbol):
    if symbol == INTENT:
        return 1, OTHER
    if symbol == HARM:
        return (2, OTHER) if state else (0, OTHER)
    if symbol == TARGET and state == 2:
        return 0, THREAT
    return state, symbol


def _target(scope, symbol):
    if symbol == TARGET:
        return TARGET_SCOPE, OTHER
    left = max(0, scope - 1)
    return (left, AIMED) if scope and symbol == INSULT else (left, symbol)


GRAMMAR = Transducer(_negation).then(Transducer(_reported)).then(Transducer(_threat)).then(Transducer(_target))
MATCHES = {INSULT: 0, AIMED: 1, NEGATED: 2, QUOTED: 3, THREAT: 4}
FEATURES = [f"clause_feature_{i}" for i in range(7)]  # weights by kind of match, strongest clause, matched clauses (log)
PRIOR = np.array([0.5, 0.7, 0.1, 0.15, 4.0, 0.3, 0.5, -3.0])
PULL = 1e-4
FLOOR = np.array([0.0, 0.0, -1.0, -1.0, 1.0, 0.0, 0.0, -9.0])


def clause_matches(symbols: list[int], weights: list[float]) -> np.ndarray:
    """Weight of the matches of each kind in a clause; a threat weighs 1."""
    out, state = np.zeros(5), GRAMMAR.start
    for symbol, w in zip(symbols, weights):
        state, found = GRAMMAR.step(state, symbol)
        k = MATCHES.get(found)
        if k is not None:
            out[k] += w if k < 4 else 1.0
    return out


_KIND = np.array([(65 <= b <= 90) or (97 <= b <= 122) or b >= 128 for b in range(256)])
_CUT = S.class_cuts(_KIND)
_FIXED = {w: k for k, ws in ((REPORT, REPORTED), (NEGATION, NEGATIONS), (INTENT, INTENTS), (HARM, HARMS), (TARGET, TARGETS)) for w in ws}


class Lexicon:
    """Weights of insult words and stems."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems

    def symbol(self, part: bytes) -> tuple[int, float]:
        text = part.decode().lower()
        if not _KIND[part[0]]:
            return (END if any(c in ".!?;\n" for c in text) else SKIP), 0.0
        best = (OTHER, 0.0)
        for w in (text,) if text.isascii() else "".join(c if c.isalpha() else " " for c in text).split():
            weight = max([self.words.get(w, 0.0), *(self.stems.get(w[:k], 0.0) for k in STEMS if len(w) > k)])
            if weight > best[1]:
                best = INSULT, weight
            elif best[0] == OTHER and w in _FIXED:
                best = _FIXED[w], 0.0
        return best


class ClauseReader:
    """Features of whole texts on a worker."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.store = S.Rows(np.float32, 2)
        self.cache = S.SegmentCache(self._encode, self.store.reset)

    def _encode(self, parts: list[bytes]) -> int:
        return self.store.append(np.array([self.lexicon.symbol(p) for p in parts], np.float32))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        raw = [(t or "").encode().lower() for t in texts]
        out = np.zeros((len(raw), len(FEATURES)))
        for ids, parts in S.chunks(raw, _CUT):
            buf, arr, starts, ends, which = S.cuts(parts, _CUT)
            if not len(starts):
                continue
            rows = self.cache.rows(buf, starts, ends, S.hash_segments(arr, starts, ends))
            symbol, weight = self.store.data[rows].T
            symbol = symbol.astype(np.int8)
            hot = (symbol == INSULT) | (symbol == HARM)
            if not hot.any():
                continue
            # clauses by number: an end or another text begins a new one
            clause = np.cumsum((symbol == END) | np.append(True, which[1:] != which[:-1]))
            wanted = np.unique(clause[hot])
            first = np.searchsorted(clause, wanted, side="left")
            last = np.searchsorted(clause, wanted, side="right")
            for s, e in zip(first.tolist(), last.tolist()):
                use = symbol[s:e] != SKIP
                got = clause_matches(symbol[s:e][use].tolist(), weight[s:e][use].tolist())
                f = out[ids[which[s]]]
                f[:5] += got
                f[5] = max(f[5], got[0] + got[1])
                f[6] += got.any()
        out[:, :4] = np.log1p(out[:, :4])
        out[:, 6] = np.log1p(out[:, 6])
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, y, text) of at most about ``per_class`` rows per class; its ids
    are broadcast, which that parameter bounds."""
    rows = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", (F.col("toxic") == 1).cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.when(F.col("y") == 1, min(1.0, per_class / n.get(1, 1))).otherwise(min(1.0, per_class / n.get(0, 1)))
    return docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(rows.where(draw < share)), "doc_id").select("doc_id", "y", "text")


def learn_lexicon(sample: DataFrame, limit: int = LEXICON) -> Lexicon:
    """Words and stems that mark toxic texts: log-odds of their document counts,
    where a likelihood ratio says that they are no accident. Equal texts count once."""
    words = sample.dropDuplicates(["text"]).select("y", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("w"))
    stems = [F.transform(F.filter("w", lambda x, k=k: F.length(x) > k), lambda x, k=k: F.concat(F.substring(x, 1, k), F.lit("*"))) for k in STEMS]
    total = {r["y"]: r["count"] for r in words.groupBy("y").count().collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not n1 or not n0:
        return Lexicon({}, {})
    share = n1 / (n0 + n1)
    counts = (words.select("y", F.explode(F.array_distinct(F.concat("w", *stems))).alias("key"))
              .groupBy("key").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
              .where((F.col("a") >= MIN_TOXIC_DOCS) & (F.col("a") * n0 > 4 * F.col("b") * n1)))
    n = F.col("a") + F.col("b")
    ratio = 2 * (F.col("a") * F.log(F.col("a") / (n * share)) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (n * (1 - share)))).otherwise(0.0))
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    found = counts.select("key", odds.alias("odds"), ratio.alias("g")).where(F.col("g") >= MIN_EVIDENCE).orderBy(F.desc("g"), "key").limit(limit).collect()
    return Lexicon({r["key"]: r["odds"] for r in found if not r["key"].endswith("*")},
                   {r["key"][:-1]: r["odds"] for r in found if r["key"].endswith("*")})


def clause_features(docs: DataFrame, lexicon: Lexicon, kept: list[str]) -> DataFrame:
    """Columns ``kept`` and the features of ``text``, one row per row."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        reader = ClauseReader(shared.value)
        return lambda texts: [pa.array(x) for x in reader(texts).T]

    return add_from_text(docs, kept, [T.StructField(name, T.DoubleType()) for name in FEATURES], make)


def fit_weights(x: np.ndarray, y: np.ndarray, share: float, steps: int = 30) -> np.ndarray:
    """Logistic weights by Newton steps, drawn to the prior and not below FLOOR;
    classes weigh as in the whole table (``share`` toxic)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = PRIOR.copy()
    if 0 < y.mean() < 1:
        row = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())) / len(y)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (row * (p - y)) + PULL * (w - PRIOR)
            bend = (x * (row * p * (1 - p))[:, None]).T @ x + PULL * np.eye(len(w))
            w = np.maximum(FLOOR, w - np.linalg.solve(bend, slope))
        w[-1] = min(w[-1], -1.5)
    return w


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_DOCS) -> ToxicityModel:
    """``labels`` (doc_id, toxic) are the rows to learn from."""
    known = {r["toxic"]: r["count"] for r in labels.where("toxic IS NOT NULL").groupBy("toxic").count().collect()}
    sample = labelled_sample(docs, labels, per_class)
    lexicon = learn_lexicon(sample)
    rows = np.array([list(r) for r in clause_features(sample, lexicon, ["y"]).collect()], float).reshape(-1, 1 + len(FEATURES))
    share = known.get(1, 0) / max(1, sum(known.values()))
    return ToxicityModel(lexicon, fit_weights(rows[:, 1:], rows[:, 0], share) if len(rows) else PRIOR.copy())


def score_toxicity(docs: DataFrame, model: ToxicityModel, kept: list[str]) -> DataFrame:
    """Columns ``kept``, ``toxicity`` (0 to 1) and ``toxic`` for every row."""
    own, found = [f"c{i}" for i in range(len(kept))], [f"x{i}" for i in range(len(FEATURES))]
    f = clause_features(docs, model.lexicon, kept).toDF(*own, *found)  # positional names: those of ``kept`` may be ours
    terms = F.lit(float(model.weights[-1]))
    for name, w in zip(found, model.weights):
        terms = terms + F.col(name) * float(w)
    f = f.select(*own, (1 / (1 + F.exp(-terms))).alias("p"))
    return f.select(*own, "p", F.col("p") >= THRESHOLD).toDF(*kept, "toxicity", "toxic")

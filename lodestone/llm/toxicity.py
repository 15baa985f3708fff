"""Toxicity by weak supervision: many noisy voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import materialised, spread, table

#: Rows with and without a label that are learned from at most (in expectation, picked by a hash of
#: doc_id).
SAMPLE_ROWS, UNLABELLED_ROWS = 12_000, 6_000
#: Voters that are single words found in the labelled sample: at most so many; in so many toxic rows
#: at least; and with this log ratio of their frequency in toxic and clean rows at least.
MINED, MINED_ROWS, MINED_LIFT = 400, 3, 2.0
#: Rows without a label count for at most this share of those with one, so that they refine what the
#: labels say and cannot outvote it.
UNLABELLED_SHARE = 0.2
#: Voters depend on each other from this correlation on, given the class.
DEPENDENT = 0.2
#: Slots of hashed words of the linear classifier; words that meet in one share a weight.
SLOTS = 1 << 16
THRESHOLD = 0.3

# Hand-written voters: words of insult and threat in a few languages, and patterns of writing.
LEXICON = {
    "insult_en": "idiot idiots moron morons stupid dumb fool loser losers scum trash garbage clown pathetic worthless disgusting imbecile jerk creep freak filthy vermin",
    "threat_en": "kill hurt destroy die hang shoot burn beat smash attack",
    "insult_de": "idiot dummkopf arschloch trottel abschaum blöd dumm ekelhaft wertlos versager",
    "insult_fr": "idiot idiote imbécile connard abruti minable ordure crétin stupide dégoûtant",
    "insult_es": "idiota imbécil estúpido estúpida basura asqueroso inútil payaso escoria tonto",
    "profanity": "damn shit fuck fucking bitch bastard crap ass asshole hell",
    "contempt_en": "useless hopeless ridiculous laughable coward liar fraud hypocrite parasite degenerate lowlife nobody weakling pig rat snake",
    "contempt_de": "feigling lügner heuchler parasit schwein ratte drecksack schwachkopf vollidiot penner",
    "contempt_fr": "lâche menteur hypocrite parasite porc rat salaud salope bouffon débile",
    "contempt_es": "cobarde mentiroso hipócrita parásito cerdo rata cabrón imbéciles bufón patético",
    "threat_de": "töten umbringen sterben verrecken schlagen erschießen verbrennen",
    "threat_fr": "tuer crever mourir frapper brûler détruire pendre",
    "threat_es": "matar morir golpear quemar destruir colgar reventar",
    "hate": "hate hatred despise loathe hass hasse verachte haine déteste odio odias desprecio",
}
# Patterns, each with words or strings of which a text must have one to be searched at all.
PATTERNS = {
    "bangs": (r"!!", ["!!"]),
    "second_person": (r"\b(?:you|du|tu|vous|usted)\b\W+(?:\w+\W+){0,3}(?:idiot\w*|moron|stupid|loser|scum|trash|clown)\b", {"idiot", "idiots", "moron", "stupid", "loser", "scum", "trash", "clown"}),
    "addressed": (r"\b(?:shut up|get lost|go away|hate you|nobody likes)\b", {"shut", "lost", "away", "hate", "nobody"}),
    "masked": (r"\b\w+[*#@$]{2,}\w+\b", ["**", "##", "@@", "$$"]),
    "wish_of_harm": (r"\b(?:hope|wish) (?:you|they|he|she) (?:all )?(?:die|rot|burn|suffer|choke)\b", {"die", "rot", "burn", "suffer", "choke"}),
    "named": (r"\b(?:such an?|what an?|total|complete|utter|absolute) (?:idiot|moron|fool|loser|clown|joke|disgrace|failure)\b", {"idiot", "moron", "fool", "loser", "clown", "joke", "disgrace", "failure"}),
    "stretched": (r"([a-z])\1{3,}", [3 * x for x in "aeiouhsznrlmo"]),
    "question_storm": (r"\?[!?]{2,}", ["??", "?!"]),
}
#: Share of capitals among ASCII letters from which a text counts as shouted.
SHOUTED = 0.3
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def _mined(batches):
    counts: dict[str, list[int]] = {}
    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for w in words_of(text or ""):
                counts.setdefault(w, [0, 0])[toxic] += 1
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([x[0] for x in counts.values()], pa.int64()), pa.array([x[1] for x in counts.values()], pa.int64())], names=["word", "clean", "toxic"])


class Voters:
    """All voters of a text: lexicons, patterns and mined words. Each fires or abstains."""

    def __init__(self, mined: list[str]):
        self.by_word: dict[str, list[int]] = {}
        self.names = []
        for name, words in LEXICON.items():
            for w in words.split():
                self.by_word.setdefault(w, []).append(len(self.names))
            self.names.append(name)
        self.patterns = []
        for name, (p, gate) in PATTERNS.items():
            self.patterns.append((len(self.names), re.compile(p), gate))
            self.names.append(name)
        self.shouting = len(self.names)
        self.names.append("shouting")
        for w in mined:
            self.by_word.setdefault(w, []).append(len(self.names))
            self.names.append(w)

    def __call__(self, text: str) -> tuple[list[int], np.ndarray]:
        """(voters that fire, hashed slots of the distinct words)."""
        lower = text.lower()
        words = set(_WORD.findall(lower))
        fired = {v for w in words & self.by_word.keys() for v in self.by_word[w]}
        for v, p, gate in self.patterns:
            if (words & gate if isinstance(gate, set) else any(x in lower for x in gate)) and p.search(lower):
                fired.add(v)
        if (letters := np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)).size:
            capital = int(((letters >= 65) & (letters <= 90)).sum())
            if capital >= 12 and capital > SHOUTED * (capital + int(((letters >= 97) & (letters <= 122)).sum())):
                fired.add(self.shouting)
        slots = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words)) % SLOTS
        return sorted(fired), slots


def _voted(sent):
    def run(batches):
        voters = sent.value
        for b in batches:
            got = [voters(x or "") for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([x for x, _ in got], pa.list_(pa.int32())), pa.array([s for _, s in got], pa.list_(pa.int32()))], names=["toxic", "fired", "slots"])

    return run


def _tree(votes: np.ndarray, post: np.ndarray, on: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The parent of each voter, or -1: the maximum spanning forest of the voters' correlations given
    the class, without those up to DEPENDENT."""
    left = votes - (post[:, None] * on + (1 - post)[:, None] * off).astype(votes.dtype)
    cov = (left.T @ left).astype(np.float64) / max(1, len(post))
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    corr = cov / scale[:, None] / scale[None, :]  # voters that exclude each other share no evidence
    m = len(scale)
    parent, best, link, todo = np.full(m, -1), np.zeros(m), np.full(m, -1), np.ones(m, bool)
    for _ in range(m):
        at = int(np.argmax(np.where(todo, best, -1)))
        parent[at], todo[at] = link[at], False
        nearer = todo & (corr[at] > DEPENDENT) & (corr[at] > best)
        best[nearer], link[nearer] = corr[at][nearer], at
    return parent


def _rates(q: np.ndarray, votes: np.ndarray, above: np.ndarray, both: np.ndarray):
    """Under row weights q: how often each voter fires, and how often if its parent does not or does;
    the latter two are drawn to the first where the parent's state is seldom seen."""
    total, fired, up, joint = q.sum(), q @ votes, q @ above, q @ both
    base = np.clip((fired + 0.1) / (total + 1), 1e-4, 1 - 1e-4)
    quiet = (fired - joint + 5 * base) / (total - up + 5)
    told = (joint + 5 * base) / (up + 5)
    return base, np.clip(quiet, 1e-4, 1 - 1e-4), np.clip(told, 1e-4, 1 - 1e-4)


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 30):
    """Posterior of toxicity of each row under a generative model of the voters.

    Given the class, every voter fires with a probability that depends on whether one other voter
    fires, its parent in a tree of the strongest correlations; so accuracies and correlations are
    both parameters. The given label is one more voter, with an error of its own; it abstains where
    ``labels`` is negative. All is estimated by expectation-maximisation over rows with and without
    label, beginning with independent voters on the labelled rows; the tree is laid anew in three of
    the rounds. Returns (posterior, rates on clean and toxic rows, parents).
    """
    given, known = labels == 1, labels >= 0
    post, weight = np.where(given, 0.9, 0.05), known.astype(np.float64)
    full = np.where(known, 1.0, min(1.0, UNLABELLED_SHARE * known.sum() / max(1, (~known).sum())))
    parent = np.full(votes.shape[1], -1)
    above = both = np.zeros_like(votes)
    for step in range(rounds):
        prior = ((weight * post).sum() + 1) / (weight.sum() + 2)
        q = {1: (weight * post).astype(votes.dtype), 0: (weight * (1 - post)).astype(votes.dtype)}
        on, off = (_rates(q[c], votes, above, both)[0].astype(np.float64) for c in (1, 0))
        if step in (1, 6, rounds // 2):
            parent = _tree(votes, post, on, off)
            above = np.where(parent >= 0, votes[:, parent], 0).astype(votes.dtype)
            both = votes * above
        told = {c: ((q[c] * (given & known)).sum() + 1) / ((q[c] * known).sum() + 2) for c in (1, 0)}
        told = {1: np.clip(told[1], 0.5, 0.99), 0: np.clip(told[0], 0.01, 0.5)}
        logit = np.full(len(labels), np.log(prior / (1 - prior)))
        for c, sign in ((1, 1), (0, -1)):
            _, quiet, up = (x.astype(np.float64) for x in _rates(q[c], votes, above, both))
            l00, l10, l01, l11 = np.log(1 - quiet), np.log(quiet), np.log(1 - up), np.log(up)
            logit += sign * (l00.sum() + votes @ (l10 - l00) + above @ (l01 - l00) + both @ (l11 - l10 - l01 + l00))
            logit += sign * np.where(known, np.where(given, np.log(told[c]), np.log(1 - told[c])), 0)
        post, weight = 1 / (1 + np.exp(-np.clip(logit, -30, 30))), full
    return post, (off, on), parent


def fit_linear(rows: list[np.ndarray], target: np.ndarray, size: int, rounds: int = 150, penalty: np.ndarray | None = None):
    """Logistic regression on binary features and soft targets, by Adam over the whole sample."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    w, bias, m, v, mb, vb = np.zeros(size), np.log(target.mean() / (1 - target.mean())), np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, w[flat], len(rows)), -30, 30)))
        error = (p - target) / len(rows)
        g = np.bincount(flat, error[row], size) + penalty * w
        gb = error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        bias -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, float(bias)


class Classifier:
    def __init__(self, voters: Voters, weights: np.ndarray, bias: float):
        self.voters, self.weights, self.bias = voters, weights, bias

    def score(self, text: str | None) -> float:
        fired, slots = self.voters(text or "")
        z = self.bias + self.weights[SLOTS + np.asarray(fired, np.int64)].sum() + self.weights[np.unique(slots)].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _fitted(n_voters: int):
    """The linear classifier's weights and bias from all voted rows, which one task has: the sample
    is bounded. Labels are null for rows without one."""

    def run(batches):
        slots, fired, labels = [], [], []
        for b in batches:
            labels += [-1 if x is None else x for x in b.column(0).to_pylist()]
            fired += [np.asarray(x, np.int64) for x in b.column(1).to_pylist()]
            slots += [np.unique(np.asarray(x, np.int64)) for x in b.column(2).to_pylist()]
        labels = np.array(labels, np.int64)
        known = labels >= 0
        weights, bias = np.zeros(SLOTS + n_voters), -30.0
        if known.any():
            votes = np.zeros((len(labels), n_voters), np.float32)
            for i, f in enumerate(fired):
                votes[i, f] = 1
            posterior, _, _ = label_model(votes, labels)
            # The label model says which rows are toxic; how far given labels follow that keeps the score's scale.
            p, y = posterior[known], labels[known]
            follow = np.array([((1 - p) @ y + 0.5) / ((1 - p).sum() + 1), (p @ y + 0.5) / (p.sum() + 1)])
            target = np.clip(posterior * follow[1] + (1 - posterior) * follow[0], 1e-4, 1 - 1e-4)
            features = [np.concatenate([s, SLOTS + f]) for s, f in zip(slots, fired)]
            penalty = np.full(SLOTS + n_voters, 1e-3)
            penalty[SLOTS:] = 1e-5
            weights, bias = fit_linear(features, target, len(penalty), penalty=penalty)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f8").tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> Classifier:
    """Learns from the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) has a label for,
    and from some of those it has none for; rows with a null id or label are left out, and of
    several labels the highest counts.

    The samples are picked by a hash of doc_id on both sides before they are joined, so only their
    own texts are moved. Words that stand out in toxic rows become voters of their own beside the
    hand-written ones; they are counted in Spark. One task fits the model, as the sample is bounded;
    the driver gets the words and the weights only. Without any labelled row every score is close
    to 0; an empty text scores as one in which nothing fires.
    """
    spark = docs.sparkSession
    given = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    total, all_of = given.count(), docs.count()
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("toxicity")), F.lit(1 << 30))
    near = lambda rows, of: part < int(min(1.0, rows / max(1, of)) * (1 << 30))
    few = near(unlabelled_rows, all_of - total)
    none = docs.where(few).join(given.where(few), "doc_id", "left_anti").select("text", F.lit(None).cast("int").alias("toxic"))
    told = docs.where(near(sample_rows, total)).join(given.where(near(sample_rows, total)), "doc_id").select("text", "toxic")
    picked = materialised(told.unionAll(none))
    rows = {r["toxic"]: r["count"] for r in picked.groupBy("toxic").count().collect()}
    counts = picked.where("toxic is not null").mapInArrow(_mined, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lift = F.log((F.col("toxic") + 0.5) / (rows.get(1, 0) + 1)) - F.log((F.col("clean") + 0.5) / (rows.get(0, 0) + 1))
    best = counts.where(F.col("toxic") >= MINED_ROWS).withColumn("lift", lift).where(F.col("lift") > MINED_LIFT).orderBy(F.desc(F.col("lift") * F.sqrt("toxic")), "word").limit(MINED).collect()
    voters = Voters([r["word"] for r in best])
    sent = spark.sparkContext.broadcast(voters)
    voted = picked.mapInArrow(_voted(sent), "toxic int, fired array<int>, slots array<int>")
    fit = voted.repartition(1).mapInArrow(_fitted(len(voters.names)), "weights binary, bias double").first()
    return Classifier(voters, np.frombuffer(fit["weights"], "<f8"), fit["bias"])


def _scored(sent):
    def run(batches):
        model = sent.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(x) for x in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, score) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Whole texts are read; a null or empty text gets the score of a text in which nothing fires.
    Repeated rows are answered each; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(_scored(sent), "doc_id long, score double")


def _passed(sent, threshold):
    def run(batches):
        model = sent.value
        for b in batches:
            keep = pa.array([model.score(x) < threshold for x in b.column(0).to_pylist()], pa.bool_())
            yield b.select([1]).filter(keep)

    return run


def reject(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (text, and any others) that score below ``threshold``, unchanged.

    Whole texts are read; null and empty ones score as in ``score``; rows without an id and repeated
    rows are judged like any other; an empty table gives an empty result; columns may have any names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("text").cast("string"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.mapInArrow(_passed(sent, threshold), T.StructType([T.StructField("row", docs.schema)]))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled rows that are not held out."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = train(docs.where(~held_out), table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))

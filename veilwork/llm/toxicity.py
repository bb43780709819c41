"""Operator 9, toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from veilwork.llm.common import crc32_text, written

# Seed lexicons of insults, one voter each.
SEEDS = {
    "mind": "idiot idiots idiotic moron morons moronic imbecile cretin stupid dumb dumbass dimwit halfwit fool retard retarded braindead",
    "worth": "worthless loser losers useless trash garbage scum scumbag filth vermin waste nobody failure rubbish parasite",
    "scorn": "pathetic disgusting disgrace repulsive vile revolting gross ugly hideous sickening despicable",
    "mock": "clown clowns buffoon joke jerk creep freak weirdo coward pig bastard bitch asshole shit fuck fucking twat prick wanker lunatic psycho",
    "german": "idioten trottel depp dummkopf blöd blöde blödmann doof dumm arschloch scheiße abschaum versager wertlos widerlich ekelhaft erbärmlich hässlich",
    "french": "idiote imbécile crétin abruti débile stupide connard connasse merde ordure minable pathétique dégoûtant raté clochard salaud",
    "spanish": "idiota imbécil estúpido estúpida tonto cretino basura escoria inútil patético asqueroso mierda cabrón perdedor fracasado payaso",
}
# Words that an insult is aimed with, a pattern voter for each language.
AIMED = {
    "english": "you your they he she", "german": "du dein ihr euer er sie bist", "french": "tu toi vous il elle es êtes",
    "spanish": "tú tu eres usted ustedes él ella",
}
INSULTS = "|".join(sorted({w for s in SEEDS.values() for w in s.split()}))
PATTERNS = {
    **{f"aimed {k}": re.compile(rf"\b(?:{'|'.join(v.split())})\b\W+(?:\w+\W+){{0,3}}?(?:{INSULTS})\b", re.I) for k, v in AIMED.items()},
    "shouted": re.compile(rf"\b(?:{INSULTS.upper()})\b|\b(?:{INSULTS})\b[^.?!\n]{{0,40}}!", re.M),
}
#: Lengths of word beginnings that are mined as stems.
STEMS = (4, 5, 6)
#: Parts that mined words are split into, a voter each, so that no one term decides a voter.
PARTS = 4
#: Bits of the map of candidate terms; texts whose terms are counted together before they leave a task.
MAP, SOME = 1 << 20, 2000
#: Bits of the map of labelled ids (8 MB, whatever the number of labels), and kinds of ids that are equal only if their hashes are.
IDS, HASHED = 1 << 26, frozenset(["bigint", "int", "string"])
#: Texts that are added to each class (of votes to abstain, as the class, against it), and to each vote of a parent.
MEANT, DRAWN = (2.4, 0.45, 0.15), 4.0
WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str) -> tuple[list[str], int]:
    """Distinct terms (words, and beginnings such as ``lost*``) of a whole text, and its number of distinct words."""
    found = set(WORD.findall(text.lower()))
    out = list(found)
    for k in STEMS:
        out.extend({w[:k] + "*" for w in found if len(w) > k})
    return out, len(found)


@dataclass(frozen=True)
class Lexicon:
    """Mined terms with their voter's number; seeds come first."""

    voters: tuple[str, ...]
    terms: dict[str, int]

    @cached_property
    def whole(self) -> frozenset[str]:
        return frozenset(t for t in self.terms if not t.endswith("*"))

    @cached_property
    def stems(self) -> dict[int, frozenset[str]]:
        return {k: frozenset(t[:-1] for t in self.terms if len(t) == k + 1 and t.endswith("*")) for k in STEMS}

    def hits(self, text: str) -> tuple[list[str], int]:
        """The lexicon's terms that a text has (mined words and stems, and the text's seeds), and its votes as a number.

        Two bits a voter: 0 abstains, 1 votes toxic, 2 votes clean. Pattern voters: an insult aimed at someone, in each
        language, an insult shouted, two or more lexicon terms, and, for clean, several words without any.
        """
        words = set(WORD.findall(text.lower()))
        found = list(words & self.whole)
        seeds = any(self.terms[w] < len(SEEDS) for w in found)
        for k, stems in self.stems.items():
            if stems:
                found.extend(s + "*" for s in {w[:k] for w in words if len(w) > k} & stems)
        votes = 0
        for t in found:
            votes |= 1 << 2 * self.terms[t]
        at = len(self.voters) - 2 - len(PATTERNS)
        for pattern in PATTERNS.values() if seeds else ():
            votes |= int(pattern.search(text) is not None) << 2 * at
            at += 1
        n = len(self.voters)
        votes |= int(len(found) > 1) << 2 * (n - 2)
        if len(words) >= 5 and not found:
            votes |= 2 << 2 * (n - 1)
        return sorted(found), votes


@dataclass(frozen=True)
class LabelModel:
    """A class draws the first voter's vote, and each other vote is drawn given the class and the vote of the voter's parent.

    ``chances`` has them by voter, class, the parent's vote and the own one; for the first voter the parent's vote makes
    no difference. The parents make the tree of the strongest correlations within classes, so voters that go together
    say little more than one of them. ``scale`` and ``shift`` calibrate the odds on labelled texts.
    """

    prior: float
    parents: np.ndarray
    chances: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def odds(self, votes: np.ndarray) -> np.ndarray:
        """Log odds of the toxic class; to abstain is a vote like any other, more or less likely in each class."""
        v, log, given = np.arange(votes.shape[1]), np.log(self.chances), votes[:, self.parents]
        return np.log(self.prior / (1 - self.prior)) + (log[v, 1, given, votes] - log[v, 0, given, votes]).sum(axis=1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.odds(votes) + self.shift, -30, 30)))

    def calibrated(self, votes: np.ndarray, labelled: np.ndarray, toxic: np.ndarray) -> LabelModel:
        """With the scale and shift that fit the labelled texts of each pattern best, drawn to 1 and 0 (Newton steps, halved until they gain)."""
        x, beta = np.stack([self.odds(votes), np.ones(len(votes))], axis=1), np.array([1.0, 0.0])

        def fit(b: np.ndarray) -> float:
            z = x @ b
            return float((toxic * z - labelled * np.logaddexp(0, z)).sum() - ((b - [1.0, 0.0]) ** 2).sum() / 2)

        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            slope = x.T @ (toxic - labelled * p) - (beta - [1.0, 0.0])
            step, size = np.linalg.solve((x * (labelled * p * (1 - p))[:, None]).T @ x + np.eye(2), slope), 1.0
            while size > 1e-6 and fit(beta + size * step) < fit(beta):
                size /= 2
            beta = beta + size * step
        return replace(self, scale=float(max(beta[0], 0.05)), shift=float(beta[1]))


def unpack_votes(codes: np.ndarray, voters: int) -> np.ndarray:
    return (codes[:, None] >> (2 * np.arange(voters))) & 3


def _strongest_tree(shared: np.ndarray) -> np.ndarray:
    """Each voter's parent in the tree of the largest sums of ``shared``, grown from the first voter (its own parent)."""
    parents, best = np.zeros(len(shared), int), shared[0].copy()
    out = np.zeros(len(shared), bool)
    out[0] = True
    for _ in range(len(shared) - 1):
        v = int(np.argmax(np.where(out, -np.inf, best)))
        out[v] = True
        nearer = ~out & (shared[v] > best)
        parents[nearer], best[nearer] = v, shared[v][nearer]
    return parents


def fit_label_model(codes: np.ndarray, counts: np.ndarray, labelled: np.ndarray, toxic: np.ndarray, voters: int, rounds: int = 25) -> LabelModel:
    """Expectation and maximisation over distinct vote patterns.

    ``counts`` has the texts of each pattern, ``labelled`` and ``toxic`` those among them with a label, and with label 1.
    In the sums, labelled texts keep their label and the others have their posterior; the share of toxic texts is that
    of the labelled ones (with one toxic and nine others added). Each round counts the votes of every two voters within
    the classes, takes the tree of the largest mutual information given the class, and each vote's chances given its
    parent's.
    """
    votes = unpack_votes(codes, voters)
    free = np.maximum(counts - labelled, 0).astype(float)
    prior = float((toxic.sum() + 1) / (labelled.sum() + 10))
    post = np.where(labelled > 0, (toxic + prior) / (labelled + 1), np.where((votes == 1).any(axis=1), 0.8, 0.05))
    each = (votes[:, :, None] == np.arange(3)).reshape(len(votes), 3 * voters).astype(float)
    v, model = np.arange(voters), None
    for _ in range(rounds):
        shared, chances = np.zeros((voters, voters)), np.empty((voters, 2, 3, 3))
        pairs = []
        for mass in (labelled - toxic + free * (1 - post), toxic + free * post):
            both = ((each * mass[:, None]).T @ each).reshape(voters, 3, voters, 3).transpose(0, 2, 1, 3)  # voter, voter, vote, vote
            own, total = both[v, v][:, [0, 1, 2], [0, 1, 2]], max(mass.sum(), 1e-9)
            chance = np.maximum(both, 1e-12) * total / np.maximum(own[:, None, :, None] * own[None, :, None, :], 1e-12)
            shared += (both * np.log(chance)).sum(axis=(2, 3))
            pairs.append((both, own))
        parents = _strongest_tree(shared)
        for c, (both, own) in enumerate(pairs):
            # votes agree with their meaning at least a little, so the classes can't change places
            own = own + np.array(MEANT)[[0, 1, 2] if c else [0, 2, 1]]
            own /= own.sum(axis=1, keepdims=True)
            given = both[parents, v] + DRAWN * own[:, None, :]
            chances[:, c] = given / given.sum(axis=2, keepdims=True)
            chances[0, c] = own[0]
        model = LabelModel(prior, parents, chances)
        post = model.posterior(votes)
    return model.calibrated(votes, labelled, toxic)


def mine(rows: DataFrame, least: float = 16.0, most: int = 1_000_000) -> Lexicon:
    """Terms of ``rows(text, toxic)`` that mark toxic texts: in three of them or more, and G-squared of at least ``least``.

    All rows count. Terms of toxic texts are counted first, with partial sums before the shuffle; a map of fixed size
    then says which terms of the other texts can be any of those, and only they are counted. All terms that pass make
    the lexicon, which goes to the driver and to tasks; more than ``most`` of them stop the job, as ``least`` is then
    too small for the corpus.
    """

    def terms(bits: np.ndarray | None):  # noqa: ANN202
        def run(batches):  # noqa: ANN001, ANN202
            for b in batches:
                for a in range(0, len(b), SOME):
                    seen: Counter[str] = Counter()
                    for text in b["text"].iloc[a : a + SOME]:
                        seen.update(terms_of(text or "")[0])
                    found = list(seen)
                    if bits is not None:
                        codes = np.fromiter((zlib.crc32(t.encode()) % MAP for t in found), np.int64, len(found))
                        found = [found[i] for i in np.flatnonzero(bits[codes])]
                    yield pd.DataFrame({"term": pd.Series(found, dtype="str"), "n": np.fromiter(map(seen.__getitem__, found), np.int64, len(found))})

        return run

    n, p = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    found = []
    if p and n > p:
        counted = rows.filter("toxic = 1").mapInPandas(terms(None), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("a"))
        counted = written(counted.filter("a > 2"), "terms")
        bits = np.zeros(MAP, bool)
        bits[[r[0] for r in counted.select(F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(MAP))).distinct().collect()]] = True
        clean = rows.filter("toxic = 0").mapInPandas(terms(bits), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("b"))
        share = F.lit(p / n)
        part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(F.lit(0.0))
        seen = counted.join(clean, "term", "left").withColumn("d", F.col("a") + F.coalesce("b", F.lit(0)))
        d, a = F.col("d"), F.col("a")
        g = 2 * (part(a, d * share) + part(d - a, d * (1 - share)) + part(p - a, (n - d) * share) + part(n - d - p + a, (n - d) * (1 - share)))
        marks = seen.filter((a > 0.8 * d) & (g >= least)).select("term")
        found = [r.term for r in marks.limit(most + 1).collect()]
        if len(found) > most:
            raise ValueError(f"more than {most} terms mark toxic texts: raise least")
    voters = [*SEEDS, *[f"word{i}" for i in range(PARTS)], *[f"stem{k}" for k in STEMS], *PATTERNS, "many", "none"]
    terms_ = {w: i for i, s in enumerate(SEEDS.values()) for w in s.split()}
    for t in sorted(found):
        if t not in terms_:
            terms_[t] = len(SEEDS) + (PARTS + STEMS.index(len(t) - 1) if t.endswith("*") else sum(map(ord, t)) % PARTS)
    return Lexicon(tuple(voters), terms_)


HITS = StructType([StructField("terms", ArrayType(StringType())), StructField("votes", LongType())])


def hits(lexicon: Lexicon):  # noqa: ANN201
    """Pandas UDF: a whole text's lexicon terms and votes; a null text has none and abstains."""

    @F.pandas_udf(HITS)
    def of(text: pd.Series) -> pd.DataFrame:
        found = [lexicon.hits(t or "") for t in text]
        return pd.DataFrame({"terms": [f[0] for f in found], "votes": [f[1] for f in found]})

    return of


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    labels: LabelModel
    vectors: CountVectorizerModel
    classifier: LogisticRegressionModel

    def score(self, found: DataFrame) -> DataFrame:
        """Adds ``score`` (0 to 1) to rows with ``terms``; whatever else the rows have stays."""
        keep = found.columns
        out = self.classifier.transform(self.vectors.transform(found))
        return out.select(*keep, vector_to_array("_probability")[1].alias("score"))


def _learned(doc_id: Column) -> Column:
    """Whether labels of a row may be learned from: crc32 of its id as text isn't divisible by 5."""
    return F.coalesce(F.pmod(crc32_text(doc_id), F.lit(5)) != 0, F.lit(True))


def _likely(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows whose ``doc_id`` can be one of ``known``: all that are, and those whose hash falls on the bit of another id.

    The hashes of the known ids are marked in a map of fixed size, which goes to all tasks, so it stays small with any
    number of labels; the more there are, the more rows pass. Ids of unlike types aren't looked up, and all rows pass.
    """
    if len(kinds := {d.schema["doc_id"].dataType.simpleString() for d in (rows, known)}) > 1 or not kinds <= HASHED:
        return rows
    at = F.pmod(F.xxhash64("doc_id"), F.lit(IDS)) + 1
    marks = known.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_marks"))
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("_marks", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("_bucket", F.bitmap_bucket_number(at)).join(F.broadcast(marks), "_bucket")
    return marked.filter(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*rows.columns)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None,
    most_patterns: int = 300_000,
) -> tuple[ToxicityModel, DataFrame]:
    """The model, and ``(doc_id, terms, votes)`` of every document, with what ``keep`` names, written on the way.

    Labels are learned from rows whose crc32(doc_id as text) mod 5 is not 0. Terms are mined from all of them. The label
    model counts the vote patterns of all documents: one row per pattern of the voters, which the driver takes; more than
    ``most_patterns`` of them (a few hundred MB there) stop the job, as nothing is left out. The classifier learns
    from posterior labels alone, of all documents that aren't held out: texts of the same terms and votes are one row
    per class, weighed by their number and the posterior.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[c.alias(n) for n, c in (keep or {}).items()])
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & _learned(F.col("doc_id")))
    known = written(known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), "labels")
    # texts move to their labels at every size, as labels grow with the corpus; those that can't have one stay where they are
    learned = rows.select("doc_id", "text").filter(_learned(F.col("doc_id")))
    lexicon = mine(written(_likely(learned, known).join(known.hint("merge"), "doc_id").select("text", "toxic"), "labelled"))
    found = rows.withColumn("_h", hits(lexicon)("text")).select("doc_id", "_h.terms", "_h.votes", *(keep or {}))
    found = written(found, "votes")

    patterns = found.select("doc_id", "votes").join(known, "doc_id", "left").groupBy("votes").agg(
        F.count(F.lit(1)).alias("n"), F.count("toxic").alias("l"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")
    )
    table = np.array(patterns.limit(most_patterns + 1).collect(), np.int64).reshape(-1, 4)
    if len(table) > most_patterns:
        raise ValueError(f"more than {most_patterns} patterns of votes: take fewer voters")
    model = fit_label_model(table[:, 0], table[:, 1], table[:, 2], table[:, 3], len(lexicon.voters))

    @F.pandas_udf("double")
    def posterior(votes: pd.Series) -> pd.Series:
        return pd.Series(model.posterior(unpack_votes(votes.to_numpy(np.int64), len(lexicon.voters))))

    learn = found.filter(_learned(F.col("doc_id"))).groupBy("terms", "votes").agg(F.count(F.lit(1)).alias("n")).withColumn("p", posterior("votes"))
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight"))))
    learn = learn.select("terms", "n", both.alias("_e")).select("terms", "_e.label", (F.greatest("_e.weight", F.lit(1e-6)) * F.col("n")).alias("weight"))
    vectors = CountVectorizerModel.from_vocabulary(sorted(lexicon.terms), inputCol="terms", outputCol="_features")
    blank = docs.sparkSession.createDataFrame([([], 0.0, 1e-3), ([], 1.0, 1e-6)], "terms array<string>, label double, weight double")
    learn = written(learn.unionByName(blank), "learn")
    fit = LogisticRegression(
        featuresCol="_features", labelCol="label", weightCol="weight", probabilityCol="_probability",
        rawPredictionCol="_raw", predictionCol="_prediction", maxIter=40, regParam=1e-4, standardization=False,
    )
    return ToxicityModel(lexicon, model, vectors, fit.fit(vectors.transform(learn))), found


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, ``score`` and ``predicted`` (1 from a score of 0.5 on).

    Whole texts are read; null and empty ones have no terms and get the score of a text without any. Labels of unknown
    or null ids are ignored, the larger of two labels of one id holds, repeated rows are scored one by one, and without
    any label the seed lexicons alone vote. Other columns are ignored, and an empty table gives an empty result.
    """
    model, found = fit_toxicity(docs, labels, id_col, text_col)
    out = model.score(found).select("doc_id", (~_learned(F.col("doc_id"))).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text isn't predicted toxic, with their own columns whatever their names.

    Rows are written with their terms and votes once, and scored from there. Null and empty texts stay, as a text
    without terms isn't toxic; repeated rows share a verdict; rows without id are judged like any other; an empty table
    stays empty.
    """
    model, found = fit_toxicity(docs, labels, keep={"_row": F.struct(*docs.columns)})
    return model.score(found.select("_row", "terms")).filter("score < 0.5").select("_row.*")

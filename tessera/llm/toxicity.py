"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding replaces compatibility forms, drops loose marks and invisible characters, lower-cases, maps look-alike
letters of other scripts to Latin ones, undoes digit substitutions and takes accents off known insults. Lexicon entries are whole words or word beginnings with a log-odds weight,
learned from labelled training documents beside the seed list. Hits inside exception phrases don't count.
The weight sum over the logarithm of the length goes through a logistic curve.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import held_out, lean, materialize, release, text_only
from tessera.llm.sampling import labelled_sample, logistic, probability

#: Labelled training documents of each class that lexicon and curve are fitted on, at most.
PER_CLASS = 4000
#: Toxic documents that a learned entry needs, and its least log-odds weight.
LEAST_DOCS, LEAST_WEIGHT = 8, 3.0
#: Lengths of word beginnings that are tried as entries.
STEMS = range(4, 9)
#: Known insults, as whole folded words; the weight holds where the labels don't say enough.
SEEDS = {
    w: weight
    for weight, text in (
        (3.0, "idiot idiots idiotic moron morons moronic scum scumbag imbecile imbeciles cretin dumbass asshole bastard bitch whore slut retard retarded dipshit douchebag jackass motherfucker fuckface"),
        (2.0, "worthless pathetic disgusting stupid stupidity loser losers dumb filthy vermin parasite subhuman degenerate trash garbage clown coward creep pervert freak lunatic nitwit halfwit dimwit blockhead"),
        (3.0, "idioten arschloch schlampe hurensohn wichser dummkopf trottel missgeburt vollidiot abschaum connard connasse salope encule abruti batard ordure idiota imbecil estupido estupida cabron puta pendejo gilipollas basura"),
    )
    for w in text.split()
}
#: Phrases in which an entry isn't meant as an insult.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "trash compactor", "garbage can", "garbage bag", "garbage truck", "garbage collector", "garbage collection", "clown fish", "circus clown",
    "pond scum", "soap scum", "worthless currency", "worthless stock", "worthless check", "worthless debt", "pathetic fallacy", "idiot proof", "idiot savant", "stupid question", "stupid mistake", "sore loser",
    "winners and losers", "parasite host", "host parasite", "malaria parasite", "intestinal parasite", "degenerate matter", "degenerate case", "degenerate eigenvalue", "dumb terminal", "dumb waiter", "dumb bell",
    "vermin control", "filthy water", "freak storm", "freak accident", "freak wave", "lunatic fringe", "flame retard", "fire retard", "basura organica", "contenedor de basura", "ordures menageres",
)

_LOOK_ALIKES = dict(zip("абвгдезиклмнопрстухіїјѕԁԛԝһαβγεηικνορτυχωɑɡɩʏıłøđƅ", "abbrdeezklmhonpctyxiijsdqwhabyenikvoptuxwagiyilodb", strict=True))
_FOLD = {ord(k): v for k, v in _LOOK_ALIKES.items()} | {ord(k): v for k, v in {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}.items()}
#: Combining marks and characters that aren't seen.
_UNSEEN = re.compile("[\u00ad\u0300-\u036f\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]+")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str | None) -> list[str]:
    """The folded words of a text. Accents tell words apart in many languages, so they go only where a known insult is left."""
    text = text or ""
    if text.isascii():
        return _WORD.findall(text.lower().translate(_FOLD))
    found = _WORD.findall(_UNSEEN.sub("", unicodedata.normalize("NFKC", text)).lower().translate(_FOLD))
    return [w if w.isascii() or (bare := _UNSEEN.sub("", unicodedata.normalize("NFKD", w))) not in SEEDS else bare for w in found]


@dataclass
class Lexicon:
    words: dict[str, float]
    stems: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 1.0
    offset: float = 0.0
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for kind, entries in (("stem", self.stems), ("word", self.words)):
                for e, w in entries.items():
                    a.add_word(f" {e}" + " " * (kind == "word"), (kind, w, len(e)))
            for phrase in self.exceptions:
                a.add_word(f" {' '.join(fold(phrase))} ", ("not", 0.0, len(" ".join(fold(phrase)))))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def weigh(self, text: str | None) -> tuple[float, int, int]:
        """Weight sum, hits and words of a text; of the entries that begin at one word the heaviest counts."""
        tokens = fold(text)
        folded = f" {' '.join(tokens)} "
        best: dict[int, float] = {}
        spans: dict[int, int] = {}
        if self.words or self.stems:
            for end, (kind, w, n) in self.automaton().iter(folded):
                start = end - n + (kind == "stem")  # the first letter's place
                if kind == "not":
                    spans[start] = max(spans.get(start, 0), start + n)
                elif w > best.get(start, 0.0):
                    best[start] = w
        begins = sorted(spans)
        reach = list(accumulate((spans[a] for a in begins), max))  # how far the phrases up to each one go
        hits = [w for s, w in best.items() if (i := bisect_right(begins, s)) == 0 or reach[i - 1] <= s]
        return math.fsum(hits), len(hits), len(tokens)

    def score(self, text: str | None) -> float:
        return float(probability(np.array(self.slope * length_share(*self.weigh(text)) + self.offset)))


def length_share(weight: float, hits: int, n: int) -> float:
    return weight / math.log2(2 + n)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the task's documents of each class have a word or a beginning."""
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def flush():
        for label, c in counts.items():
            if c:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([label] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["term", "label", "n"])
            c.clear()

    for batch in batches:
        for text, label in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            seen = set(fold(text.as_py()))
            stems = {w[:k] + "*" for w in seen for k in STEMS if len(w) > k}
            counts[label].update(seen | stems)
            if sum(map(len, counts.values())) > 400_000:
                yield from flush()
    yield from flush()


def choose(found: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their weights. A stem that one longer entry all but explains gives way to it; entries that a stem covers go."""
    least = min(LEAST_DOCS, max(3, n_toxic // 5))
    rows = {}
    for term, a, b in found:
        w = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))
        if a >= least and w >= LEAST_WEIGHT:
            rows[term] = (a, w)
    dropped = set()
    for term, (a, _) in rows.items():
        bare = term.removesuffix("*")
        for k in STEMS:
            stem = bare[:k] + "*"
            if stem != term and len(bare) >= k and stem in rows and a >= 0.9 * rows[stem][0]:
                dropped.add(stem)
    kept = {t: v for t, v in rows.items() if t not in dropped}
    stems = {t[:-1]: w for t, (_, w) in kept.items() if t.endswith("*")}
    top = {s: w for s, w in stems.items() if not any(s[:k] in stems for k in range(1, len(s)))}
    words = {t: w for t, (_, w) in kept.items() if not t.endswith("*") and not any(t[:k] in top for k in range(1, len(t)))}
    return words, top


def learn(docs: DataFrame, labels: DataFrame, mod: int = 5, per_class: int = PER_CLASS) -> Lexicon:
    sample, prior = labelled_sample(docs, labels, "toxic", mod, per_class)
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    terms = sample.mapInArrow(lean(_terms), "term string, label int, n long").groupBy("term").agg(F.sum(F.expr("if(label = 1, n, 0)")).alias("a"), F.sum(F.expr("if(label = 0, n, 0)")).alias("b"))
    terms = materialize(terms)
    # as many as a sample of bounded size has entries that are common in one class and rare in the other
    found = [tuple(r) for r in terms.filter(F.col("a") >= min(LEAST_DOCS, max(3, toxic // 5))).filter(F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (clean + 1)) >= LEAST_WEIGHT).collect()]
    own, stems = choose(found, toxic, clean)
    # a seed that the labelled texts have often enough weighs what they say
    told = {r.term: r.w for r in terms.filter(F.col("term").isin(sorted(SEEDS)) & (F.col("a") + F.col("b") >= LEAST_DOCS)).select("term", (F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (clean + 1))).alias("w")).collect()}
    lexicon = Lexicon({w: v for w, v in (SEEDS | told).items() if v > 0} | own, stems)
    release(terms)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [length_share(*lexicon.weigh(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(x, pa.float64())], names=["label", "x"])

    got = sorted(tuple(r) for r in sample.mapInArrow(shares, "label int, x double").collect())
    lexicon.slope, lexicon.offset = logistic(np.array([x for _, x in got]), np.array([y for y, _ in got]), prior)
    return lexicon


def toxicity_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5, mod: int = 5, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted, hits for every row of docs (doc_id, text); labels has doc_id and toxic.

    Null and empty texts have no hits. Repeated rows are scored each. Without labels the seed list alone
    counts and every score is the prior's. An empty table gives no rows.
    """
    lexicon = spark.sparkContext.broadcast(learn(docs, labels, mod, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lexicon.value
        for batch in batches:
            found = [m.weigh(t.as_py()) for t in batch.column(1)]
            x = np.array([length_share(*f) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probability(m.slope * x + m.offset)), pa.array([h for _, h, _ in found], pa.int64())], names=["doc_id", "score", "hits"])

    docs = text_only(docs, "doc_id", "text")
    out = docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, hits long")
    return out.select("doc_id", held_out("doc_id", mod).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "hits")

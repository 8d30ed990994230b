"""Subject areas of each document.

Curated terms and terms learned from labelled documents carry weights: rare terms weigh more, and so do terms that keep
to one area. A multi-pattern automaton finds them (leftmost, longest first) in the text on the invention, its abstract
and claims. A term's occurrences count less the longer that text is than the mean (and each further one less than the
one before); the sum of its terms so weighted is an area's score. Every area is assigned whose score exceeds the area's
own threshold and whose part of the document's total exceeds a common one; a document whose terms are too few for its
length has no area.

Weights and thresholds are fitted on a sample of labelled documents, at most SAMPLE of them, taken by hash of the id:
thresholds by the scores that documents get from terms learned on the other half of the sample, never on themselves.
Every document is scored, over its whole abstract and claims, or its whole text where these hold no known term.

Defined cases: null, empty and blank texts, and texts without any known term, have no area; raters that disagree count
as several areas of a document; labels of unknown documents and terms with a null area or term are left out; without
labels the curated terms and default thresholds serve; an area with few labelled documents takes the threshold of all
areas together; repeated doc_ids are judged row by row, equal rows given once; ties between areas are all assigned.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.patents import invention, normal, phrases
from tidemark.session import materialise, ship

#: Most labelled documents that the weights and thresholds are fitted on.
SAMPLE = 4000
#: A learned term occurs in at least so many documents of the sample, and so large a part of them has its area.
LEAST_DOCUMENTS, LEAST_PURITY = 4, 0.9
#: A curated term that the sample shows below this purity is dropped as ambiguous.
CURATED_PURITY = 0.8
#: How soon further occurrences of a term count less, how far the length of a text counts, and the mean length in bytes where no sample tells it.
SATURATION, LENGTH_PART, DEFAULT_LENGTH = 1.2, 0.75, 2000.0
SHARES = tuple(k / 40 for k in range(2, 17))
DEFAULT_SHARE, DEFAULT_SCORE = 0.15, 1.0
#: An area with fewer labelled documents has no threshold of its own.
LEAST_LABELLED = 20


def _is_word(ch: str) -> bool:
    return ch.isalnum() and not "㐀" <= ch <= "鿿"


class Matcher:
    """Finds terms at word bounds (a plural s may follow); of overlapping ones the leftmost and longest counts."""

    def __init__(self, terms):
        self.automaton = ahocorasick.Automaton()
        for term in terms:
            self.automaton.add_word(term, term)
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[str]:
        if self.empty:
            return []
        n, found = len(text), []
        for end, term in self.automaton.iter(text):
            start, after = end - len(term) + 1, end + 1
            if start and _is_word(text[start - 1]) and _is_word(term[0]):
                continue
            if after < n and _is_word(text[after]) and _is_word(term[-1]):
                if text[after] != "s" or (after + 1 < n and _is_word(text[after + 1])):
                    continue
                after += 1
            found.append((start, -after, term))
        found.sort()
        out, end = [], 0
        for start, after, term in found:
            if start >= end:
                out.append(term)
                end = -after
        return out


def curated_terms(terms: DataFrame) -> dict[str, str]:
    """Term in normal form -> area; terms of several areas are left out. The table is a word list of bounded size."""
    areas = defaultdict(set)
    for r in terms.where("area is not null and term is not null").select("area", "term").distinct().collect():
        if term := normal(r["term"]).strip():
            areas[term].add(r["area"])
    return {t: next(iter(a)) for t, a in areas.items() if len(a) == 1}


def _training_area(seen: set[str], said: set[str]) -> str | None:
    """The area of a sample document, if its curated terms and its raters leave one: raters err, and so do single terms."""
    both = said if not seen else seen & said
    if len(both) == 1 and (not seen or seen == said or len(seen) <= 2):
        return next(iter(both))
    return None


def labelled_sample(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, areas) of at most SAMPLE labelled documents."""
    known = labels.where("doc_id is not null and area is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("area")).alias("areas"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most SAMPLE rows
    return texts.select("doc_id", F.col("text"), "areas")


def _phrase_counts(sample: DataFrame, curated: dict[str, str]) -> DataFrame:
    """(phrase, area, fold, n): sample documents with the phrase, by area and half of the sample; a null phrase counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(curated)
        counts: dict[tuple, Counter] = defaultdict(Counter)
        for batch in batches:
            for text, areas, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "areas", "fold"))):
                own = invention(normal(text))
                area = _training_area({curated[t] for t in matcher.find(own)}, set(areas))
                if area is not None:
                    counts[area, fold].update(phrases(own))
                    counts[area, fold][None] += 1
        rows = [(p, *k, n) for k, c in counts.items() for p, n in c.items()]
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["phrase", "area", "fold", "n"])

    return sample.select("text", "areas", "fold").mapInArrow(run, "phrase string, area string, fold int, n bigint").groupBy("phrase", "area", "fold").agg(F.sum("n").alias("n"))


def _inner(phrase: str) -> Iterator[str]:
    """The shorter phrases within a phrase."""
    if " " in phrase:
        words = phrase.split(" ")
        yield from (" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1) if j - i < len(words))
    elif "㐀" <= phrase[0] <= "鿿":
        yield from (phrase[i:j] for i in range(len(phrase)) for j in range(i + 2, len(phrase) + 1) if j - i < len(phrase))


def _ends(phrase: str) -> tuple[str, str]:
    if " " in phrase:
        return phrase.split(" ")[0], phrase.split(" ")[-1]
    return (phrase[0], phrase[-1]) if "㐀" <= phrase[0] <= "鿿" else (phrase, phrase)


def learn_terms(counts: DataFrame, curated: dict[str, str]) -> dict[str, tuple[str, float]]:
    """Term -> (area, weight), from (phrase, area, n). What comes back grows with the vocabulary of the bounded sample, not with the corpus."""
    by = F.map_from_entries(F.collect_list(F.struct("area", "n")))
    rows = counts.groupBy("phrase").agg(F.sum("n").alias("all"), F.max(F.struct("n", "area")).alias("top"), by.alias("by"))
    # of the phrases that keep to no area only curated ones and single words matter, as the ends of others
    matters = F.col("phrase").isNull() | (F.col("top.n") >= (LEAST_PURITY - 0.1) * F.col("all")) | (F.instr("phrase", " ") == 0) | F.col("phrase").isin(list(curated))
    rows = rows.where((F.col("all") >= LEAST_DOCUMENTS) & matters).collect()
    documents = sum(r["all"] for r in rows if r["phrase"] is None) or 1
    stats = {r["phrase"]: r for r in rows if r["phrase"] is not None}

    def purity(hits: int, total: int, prior: float) -> float:
        return (hits + prior) / (total + 2 * prior)

    def common(word: str) -> bool:
        """A word of the language rather than of an area: often there, and in several areas."""
        s = stats.get(word)
        return s is not None and s["top"]["n"] < 0.6 * s["all"] and s["all"] >= 2 * LEAST_DOCUMENTS

    learned = {}
    for phrase, s in stats.items():
        p = purity(s["top"]["n"], s["all"], 0.2)
        if p >= LEAST_PURITY and len(phrase) > 1 and not any(map(common, _ends(phrase))):
            learned[phrase] = (s["top"]["area"], p, s["all"])
    for term, area in curated.items():
        s = stats.get(term)
        total = s["all"] if s else 0
        p = ((s["by"].get(area, 0) if s else 0) + 2) / (total + 2)
        if p >= CURATED_PURITY:
            learned[term] = (area, p, total)
        else:
            learned.pop(term, None)
    # a phrase says nothing more than a shorter one of the same area within it
    kept = {t: v for t, v in learned.items() if t in curated or not any(q in learned and learned[q][0] == v[0] and learned[q][1] >= v[1] - 0.03 for q in _inner(t))}
    return {t: (area, (2 * p - 1) * math.log(1 + documents / (1 + n))) for t, (area, p, n) in kept.items()}


def score(text: str | None, matcher: Matcher, weights: dict[str, tuple[str, float]], mean_length: float) -> dict[str, float]:
    """Score of each area: the weights of its terms by their occurrences, in proportion to the length of the text on the invention."""
    if text is None or not text.strip():
        return {}
    whole = normal(text)
    own = invention(whole)
    found = matcher.find(own)
    if not found:  # nothing known in the abstract and claims: the whole text decides
        own, found = whole, matcher.find(whole)
    scores: dict[str, float] = defaultdict(float)
    damp = SATURATION * (1 - LENGTH_PART + LENGTH_PART * len(own.encode("utf-8", "replace")) / mean_length)
    for term, n in Counter(found).items():
        area, weight = weights[term]
        scores[area] += weight * n * (SATURATION + 1) / (n + damp)
    return dict(scores)


class Model:
    """Weights of terms, mean length, and thresholds; what a worker builds from it is kept for its next tasks."""

    _built: dict[str, Matcher] = {}

    def __init__(self, weights: dict[str, tuple[str, float]], mean_length: float, share: float = DEFAULT_SHARE, least: dict[str | None, float] | None = None):
        self.weights, self.mean_length, self.share, self.least = weights, mean_length, share, least or {None: DEFAULT_SCORE}
        self.key = uuid.uuid4().hex

    def scores(self, text: str | None) -> dict[str, float]:
        if (matcher := Model._built.get(self.key)) is None:
            Model._built.clear()
            matcher = Model._built[self.key] = Matcher(self.weights)
        return score(text, matcher, self.weights, self.mean_length)

    def assign(self, scores: dict[str, float]) -> list[str]:
        total = sum(scores.values())
        return sorted(a for a, s in scores.items() if s > 0 and s >= self.least.get(a, self.least[None]) and s >= self.share * total)


def _best_cut(scores: np.ndarray, said: np.ndarray, missed: int) -> tuple[float, float]:
    """(score, F1) of the threshold at which the areas found agree best with the raters; ``missed`` are labels without any score.

    Of thresholds that agree about as well, within one label, the lowest: it lies below every score that any of them accepts.
    """
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(said[order])
    f1 = 2 * right / (np.arange(1, len(order) + 1) + said.sum() + missed)
    last = np.append(scores[order][1:] < scores[order][:-1], True)  # a threshold takes all of a tie
    f1 = np.where(last, f1, -1.0)
    k = int(np.nonzero(f1 >= f1.max() - 1 / (said.sum() + missed + 1))[0][-1])
    below = scores[order][k + 1] if k + 1 < len(order) else 0.0
    return float((scores[order][k] + below) / 2), float(f1[k])


def calibrate(held_out: list[tuple[dict[str, float], set[str]]]) -> tuple[float, dict[str | None, float]]:
    """(share, least score by area) that agree best (F1) with the raters, over (scores, areas said) of documents that the terms weren't learned on."""
    areas = sorted({a for scores, said in held_out for a in (*scores, *said)})
    best = None
    for share in SHARES:
        rows = [(a, s, a in said) for scores, said in held_out for a, s in scores.items() if s > 0 and s >= share * sum(scores.values())]
        if not rows:
            continue
        names, values, hits = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], dtype=float)
        asked = Counter(a for _, said in held_out for a in said)
        least: dict[str | None, float] = {None: _best_cut(values, hits, sum(asked.values()) - int(hits.sum()))[0]}
        for a in areas:
            here = names == a
            if asked[a] >= LEAST_LABELLED and here.any():
                least[a] = _best_cut(values[here], hits[here], asked[a] - int(hits[here].sum()))[0]
        taken = values >= np.array([least.get(a, least[None]) for a in names])
        f1 = 2 * hits[taken].sum() / (taken.sum() + sum(asked.values()))
        if best is None or f1 > best[0] + 1e-9:
            best = (f1, share, least)
    return (best[1], best[2]) if best else (DEFAULT_SHARE, {None: DEFAULT_SCORE})


def _held_out_scores(sample: DataFrame, models: dict[int, Model]) -> list[tuple[dict[str, float], set[str]]]:
    """Scores of each sample document by the terms of the other half, with the raters' areas: at most SAMPLE rows come back."""
    shared = sample.sparkSession.sparkContext.broadcast(models)  # terms of the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = {fold: Matcher(m.weights) for fold, m in shared.value.items()}
        for batch in batches:
            out = []
            for text, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist()):
                m = shared.value[fold]
                out.append(list(score(text, matchers[fold], m.weights, m.mean_length).items()))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.map_(pa.string(), pa.float64())), batch.column("areas")], names=["scores", "areas"])

    rows = sample.select("text", "fold", "areas").mapInArrow(run, "scores map<string,double>, areas array<string>").collect()
    return [(dict(r["scores"]), set(r["areas"])) for r in rows]


def fit(documents: DataFrame, terms: DataFrame, labels: DataFrame) -> Model:
    """The model of a corpus's terms and labels."""
    ship(documents.sparkSession)
    curated = curated_terms(terms)
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = labelled_sample(documents, labels).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int"))
    sample = materialise(sample.repartition(parts, "doc_id"), "labelled-sample")
    mean = float(sample.agg(F.avg(F.octet_length("text"))).first()[0] or DEFAULT_LENGTH) / 2  # of abstract and claims, about half of a text
    counts = materialise(_phrase_counts(sample, curated), "phrases")
    halves = {fold: Model(learn_terms(counts.where(F.col("fold") == 1 - fold).drop("fold"), curated), mean) for fold in (0, 1)}
    share, least = calibrate(_held_out_scores(sample, halves))
    every = counts.groupBy("phrase", "area").agg(F.sum("n").alias("n"))
    return Model(learn_terms(every, curated), mean, share, least)


def subject_areas(documents: DataFrame, terms: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, area): every area of each document."""
    shared = documents.sparkSession.sparkContext.broadcast(model or fit(documents, terms, labels))  # terms of the bounded sample
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows, areas = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for area in model.assign(model.scores(text)):
                    rows.append(k)
                    areas.append(area)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(areas, pa.string())], names=["doc_id", "area"])

    return documents.where("text is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, area string").distinct()


def composition(areas: DataFrame) -> DataFrame:
    """(area, documents, share): how many documents have each area, and their share of all documents with an area."""
    areas = materialise(areas, "areas")
    known = areas.agg(F.countDistinct("doc_id")).first()[0]  # one number
    counts = areas.groupBy("area").agg(F.countDistinct("doc_id").alias("documents"))
    return counts.select("area", "documents", F.round(F.col("documents") / known, 6).alias("share"))

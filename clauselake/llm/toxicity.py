"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata, with quotation told from abuse by context.

Words and word stems that stand in far more toxic than clean training texts make the lexicon.  Its trie is intersected
with the automaton of all strings within the allowed edit distance, made deterministic as words walk through it, so a
word costs a few steps until it leaves the automaton, and misspelled terms are found like others.  The window around each
hit tells whether it is quoted and how many hits are beside it.  A logistic model over the weights of quoted and other
hits gives the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.common import held_out, record_batch, sliced, stored, strings

TRAIN_ROWS = 20_000
"""Labelled rows of each label that the model is fitted on, those with the smallest hashes of their ids."""

MAX_TERMS = 5_000
"""Terms of the lexicon, the most telling ones."""

STEMS = (4, 5)
"""Lengths of the word heads that may become terms; a stem matches every word that starts with it."""

WINDOW = 5
"""Words on each side of a hit that are its context."""

MAX_WEIGHT = 6.0

SHARE, SHARE_WORDS = 0.8, 5
"""Share of a term's weight that a misspelling has before any evidence, and the number of words this is worth."""

THRESHOLD = 0.7

EDGES = "\"'`´“”„«»‹›‘’()[]{}<>.,;:!?¡¿*_~&#$%|-"
ENDS = {'"': '"', "“": "”", "„": "“”", "«": "»", "‹": "›", "‘": "’"}
OPENING = "".join(ENDS)

REMEMBER = 300_000
"""Words whose match is remembered per worker."""


def edit_limit(length: int) -> int:
    """Edits allowed for a term of this length."""
    return 0 if length < 4 else 1


@dataclass(frozen=True)
class Term:
    """A lexicon entry; a stem stands for all words that start with it, exact only."""

    text: str
    stem: bool
    weight: float
    misspelled: float = 0.0
    near: tuple[tuple[str, float], ...] = ()  # misspellings that clean training texts hold, with weights of their own


class LexiconAutomaton:
    """Trie of the terms, intersected with the Levenshtein automata of words.

    A state is the set of (trie node, edits so far) that a word's head can have reached; states and steps are made when
    a word needs them and remembered.
    """

    def __init__(self, terms: Sequence[Term]):
        self.terms = terms
        self._children: list[dict[str, int]] = [{}]
        self._whole: dict[int, int] = {}
        self._stem: dict[int, int] = {}
        self._limit: list[int] = [0]  # most edits allowed by any term below a node
        for i, term in enumerate(terms):
            node, limit = 0, 0 if term.stem else edit_limit(len(term.text))
            self._limit[0] = max(self._limit[0], limit)
            for c in term.text:
                child = self._children[node].get(c)
                if child is None:
                    child = self._children[node][c] = len(self._children)
                    self._children.append({})
                    self._limit.append(0)
                node = child
                self._limit[node] = max(self._limit[node], limit)
            (self._stem if term.stem else self._whole)[node] = i
        self._start = self._closed({0: 0})
        self._steps: dict[tuple, tuple] = {}

    def _closed(self, reached: dict[int, int]) -> tuple:
        """The state with the nodes that follow by leaving letters of a term out."""
        todo = list(reached.items())
        while todo:
            node, edits = todo.pop()
            for child in self._children[node].values():
                if edits < self._limit[child] and reached.get(child, 9) > edits + 1:
                    reached[child] = edits + 1
                    todo.append((child, edits + 1))
        return tuple(sorted(reached.items()))

    def _step(self, state: tuple, c: str) -> tuple:
        key = (state, c)
        found = self._steps.get(key)
        if found is not None:
            return found
        reached: dict[int, int] = {}
        for node, edits in state:
            for letter, child in self._children[node].items():
                now = edits if letter == c else edits + 1  # the letter itself, or another one in its place
                if (now == edits or now <= self._limit[child]) and reached.get(child, 9) > now:
                    reached[child] = now
            if edits < self._limit[node] and reached.get(node, 9) > edits + 1:
                reached[node] = edits + 1  # a letter too many
        if len(self._steps) > REMEMBER:
            self._steps.clear()
        made = self._steps[key] = self._closed(reached)
        return made

    def match(self, word: str) -> tuple[int, int] | None:
        """Term and number of edits of the best match, or None."""
        state, stem = self._start, None
        for c in word:
            state = self._step(state, c)
            if not state:
                break
            for node, edits in state:
                if edits == 0 and node in self._stem:
                    stem = self._stem[node]
        best = None
        for node, edits in state:
            term = self._whole.get(node)
            if term is not None and edits <= edit_limit(len(self.terms[term].text)) and (best is None or edits < best[1]):
                best = (term, edits)
        if stem is not None and (best is None or best[1] > 0):
            return stem, 0
        return best


def words_of(text: str) -> tuple[list[str], list[str]]:
    """The blank-separated runs of a text in lower case, as they are and without marks at their ends."""
    raw = text.lower().split()
    return raw, [w.strip(EDGES) for w in raw]


def quoted(raw: Sequence[str], at: int) -> bool:
    """Whether a quotation that opens at or before a word, within the window, closes at or after it.

    Marks are paired from left to right: a closing mark ends the last open quotation that it can end.
    """
    first = max(0, at - WINDOW)
    opened: list[tuple[int, str]] = []  # the words where quotations began that are still open, and the marks that end them
    for i in range(first, min(len(raw), at + WINDOW + 1)):
        word = raw[i]
        tail = word.lstrip(EDGES)
        lead, tail = word[: len(word) - len(tail)], tail[len(tail.rstrip(EDGES)):]
        if len(lead) == len(word):  # marks only: each ends a quotation if it can, and opens one if not
            lead, tail = "", word
        for c in lead:
            if c in OPENING:
                opened.append((i, ENDS[c]))
        for c in tail:
            n = next((n for n in range(len(opened) - 1, -1, -1) if c in opened[n][1]), None)
            if n is not None:
                if opened[n][0] <= at <= i:
                    return True
                del opened[n:]
            elif len(tail) == len(word) and c in OPENING:
                opened.append((i, ENDS[c]))
        if i >= at and not any(o <= at for o, _ in opened):
            return False
    return False


class Scorer:
    """Features and scores of texts by a lexicon and a fitted model."""

    FEATURES = 5

    def __init__(self, terms: Sequence[Term], model: Sequence[float] | None = None):
        self._automaton = LexiconAutomaton(terms)
        self._near = {(i, w): weight for i, t in enumerate(terms) for w, weight in t.near}
        self._model = model
        self._known: dict[str, tuple[float, bool] | None] = {}

    def _look(self, word: str) -> tuple[float, bool] | None:
        """Weight of a word, and whether it is misspelled."""
        found = self._automaton.match(word) if word else None
        term = self._automaton.terms[found[0]] if found else None
        got = None if term is None else (
            self._near.get((found[0], word), term.misspelled) if found[1] else term.weight, found[1] > 0)
        if len(self._known) > REMEMBER:
            self._known.clear()
        self._known[word] = got
        return got

    def hits(self, text: str) -> list[tuple[int, float, bool, bool]]:
        """Word number, weight, misspelled and quoted of each hit."""
        raw, words = words_of(text)
        known = self._known
        for w in {w for w in words if w not in known}:
            self._look(w)
        got = [known[w] if w in known else self._look(w) for w in words]
        return [(i, g[0], g[1], quoted(raw, i)) for i, g in enumerate(got) if g is not None]

    def features(self, text: str) -> list[float]:
        """Strongest weight, by how much it is a misspelling's, summed and quoted weights; hits close together count more.

        A misspelled hit goes the way of an exact one, so that it counts by its weight even if no training text has any.
        """
        exact = fuzzy = said = total = 0.0
        hits = self.hits(text)
        for n, (at, weight, misspelled, is_quoted) in enumerate(hits):
            beside = sum(abs(other - at) <= WINDOW for other, *_ in hits[max(0, n - WINDOW): n + WINDOW + 1]) - 1
            context = weight * (1 + 0.25 * beside)
            if is_quoted:
                said += weight
                continue
            total += context
            if misspelled:
                fuzzy = max(fuzzy, weight)
            else:
                exact = max(exact, weight)
        return [1.0, max(exact, fuzzy), max(0.0, fuzzy - exact), math.log1p(total), math.log1p(said)]

    def score(self, text: str) -> float:
        """Likelihood of the label, between 0 and 1."""
        z = sum(a * b for a, b in zip(self._model, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train_ids(labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id and y of the training rows: at most `rows` of each label, none whose crc32(doc_id) mod 3 is 1."""
    per = labels.filter(labels[label].isNotNull() & labels["doc_id"].isNotNull() & ~held_out("doc_id", 3, 1)).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    parts = [per.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def _evidence(train: DataFrame) -> DataFrame:
    """Words and stems with the number of toxic and clean training texts that have them: word, stem, bad, good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("stem", pa.bool_()), ("bad", pa.int64()), ("good", pa.int64())])
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            keys = list(dict.fromkeys([*counts[1], *counts[0]]))
            made = record_batch(schema, word=[k[0] for k in keys], stem=[k[1] for k in keys],
                                bad=[counts[1][k] for k in keys], good=[counts[0][k] for k in keys])
            counts[0].clear()
            counts[1].clear()
            return made

        for batch in sliced(batches, "text", 2 << 20):
            for y, text in zip(batch.column("y").to_pylist(), strings(batch.column("text"))):
                words = set(words_of(text)[1]) - {""}
                counts[y].update([(w, False) for w in words])
                for n in STEMS:
                    counts[y].update([(s, True) for s in {w[:n] for w in words if len(w) >= n}])
            if len(counts[0]) + len(counts[1]) > 200_000:
                yield flush()
        yield flush()

    return train.mapInArrow(run, "word string, stem boolean, bad long, good long").groupBy("word", "stem").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def learn_lexicon(evidence: DataFrame, n_bad: int, n_good: int, most: int = MAX_TERMS) -> list[Term]:
    """The terms, each with a weight, and one for its misspellings.

    Those have a share of the term's weight that is estimated over all terms together, lowered where most words close to
    a term stand in clean training texts; a misspelling that clean training texts hold goes by its own numbers.

    A term must be so unevenly spread that among all words less than one would be by chance.
    """
    if not n_bad or not n_good:
        return []
    share = n_bad / (n_bad + n_good)
    both = F.col("bad") + F.col("good")

    def part(n, p):
        return F.when(n > 0, n * F.log(n / (both * p))).otherwise(0.0)

    told = evidence.withColumn("llr", part(F.col("bad"), share) + part(F.col("good"), 1 - share)).withColumn(
        "weight", F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1)))
    vocabulary = max(2, evidence.count())
    chosen = told.filter((F.col("weight") > 2.0) & (F.col("llr") > math.log(vocabulary))).orderBy(
        F.desc("llr"), "word", "stem").limit(most).collect()
    terms = [Term(r["word"], r["stem"], min(MAX_WEIGHT, r["weight"])) for r in chosen]
    if not terms:
        return []
    shared = evidence.sparkSession.sparkContext.broadcast(terms)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("term", pa.int32()), ("word", pa.string()), ("bad", pa.int64()), ("good", pa.int64())])
        automaton = LexiconAutomaton(shared.value)
        for batch in batches:
            rows = [(found[0], w, b, g) for w, b, g in zip(*(c.to_pylist() for c in batch.columns))
                    if (found := automaton.match(w)) is not None and found[1] > 0]
            yield record_batch(schema, **{f.name: [r[i] for r in rows] for i, f in enumerate(schema)})

    seen: dict[int, list[tuple[str, int, int]]] = {}
    for r in evidence.filter("not stem").select("word", "bad", "good").mapInArrow(  # words of the training texts, one edit off
            near, "term int, word string, bad long, good long").orderBy("term", "word").collect():
        seen.setdefault(r["term"], []).append((r["word"], r["bad"], r["good"]))
    odds = n_bad / n_good

    def sides(words: list[tuple[str, int, int]]) -> tuple[float, float]:
        """Words that toxic texts hold more often, and those that clean texts do, for texts of equal number."""
        bad = sum(b > g * odds for _, b, g in words)
        return bad, (len(words) - bad) * min(1.0, odds)

    bad, good = sides([w for words in seen.values() for w in words])
    share = (bad + SHARE * SHARE_WORDS) / (bad + good + SHARE_WORDS)
    out = []
    for i, t in enumerate(terms):
        bad, good = sides(seen.get(i, []))
        weight = 0.0 if t.stem else t.weight * (bad + share * SHARE_WORDS) / (bad + good + SHARE_WORDS)
        own = [(w, math.log(b + 1) - math.log(g * odds + math.exp(-weight))) for w, b, g in seen.get(i, []) if g]
        out.append(Term(t.text, t.stem, t.weight, weight, tuple((w, min(weight, max(0.0, v))) for w, v in own)))
    return out


def fit(rows: Sequence[tuple[int, Sequence[float]]]) -> list[float]:
    """Logistic model by Newton steps; the ridge pulls towards a prior in which quoted hits say little."""
    prior = np.array([-2.0, 1.0, 0.0, 0.5, 0.1])
    if not rows:
        return prior.tolist()
    y = np.array([r[0] for r in rows], float)
    x = np.array([r[1] for r in rows], float)
    w, ridge = prior.copy(), np.array([0.01, 1.0, 1.0, 1.0, 1.0])

    def loss(v: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ v)).sum() + (ridge * (v - prior) ** 2).sum() / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), grad)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w.tolist()


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label: str = "toxic", rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_hits.

    The lexicon and the model come from at most `rows` labelled training texts of each label; the score reads the whole
    text only.  A null or empty text has no hits and the score of a text without hits; rows that repeat come out as
    often; without labels of both sorts there is no lexicon, and the score is the prior's.  An empty table gives no rows.
    """
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    chosen = stored(train_ids(labels, label, rows), "toxic-train-ids")
    train = stored(texts.join(F.broadcast(chosen), "doc_id").select("y", "text"), "toxic-train")  # 2 * rows ids at most
    sizes = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    evidence = stored(_evidence(train), "toxic-words")
    terms = learn_lexicon(evidence, sizes.get(1, 0), sizes.get(0, 0))
    lexicon = docs.sparkSession.sparkContext.broadcast(terms)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64())), ("n", pa.int64())])
        scorer = Scorer(lexicon.value)
        for batch in sliced(batches, "text", 2 << 20):
            found = Counter((y, tuple(scorer.features(t))) for y, t in zip(batch.column("y").to_pylist(), strings(batch.column("text"))))
            yield record_batch(schema, y=[k[0] for k in found], x=[list(k[1]) for k in found], n=list(found.values()))

    seen = train.mapInArrow(features, "y int, x array<double>, n long").collect()  # 2 * rows at most
    model = fit([(r["y"], r["x"]) for r in seen for _ in range(r["n"])])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()),
                            ("predicted", pa.int32()), ("n_hits", pa.int64())])
        scorer = Scorer(lexicon.value, model)
        for batch in sliced(batches, "text", 2 << 20):
            made = strings(batch.column("text"))
            got = [scorer.score(t) for t in made]
            yield record_batch(schema, doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), score=got,
                               predicted=[int(s >= THRESHOLD) for s in got], n_hits=[len(scorer.hits(t)) for t in made])

    return texts.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "text").mapInArrow(
        scores, "doc_id long, held_out boolean, score double, predicted int, n_hits long")

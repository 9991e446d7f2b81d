"""Toxicity by class-conditional Kneser-Ney models.

Words are spelt out between marks for their beginning and end.  Toxic and ordinary letter models of order
ORDER + 1 are counted over distinct words of distinct labelled texts; both back off to one shared Kneser-Ney
model, whose continuation counts come from the words of all documents.  An unseen ending of a known toxic
stem is thus still telling, while spellings that neither class has seen say nothing.

A span's evidence is its toxic minus its ordinary log-likelihood over its length in letters.  The spans are the whole
document, all of its words in order and as often as they stand, and every run of SPANS words; of each length of run
the span that speaks most for toxicity counts, for one telling expression vanishes in the mean of a long text.  A logistic
scaling, fitted on labelled rows that the models haven't counted, turns these into a score.

Every labelled row of the training folds is counted or scales the scores; none is sampled.  The spellings that
labelled texts hold have a likelihood ratio of their own, found by joins.  The table sent to executors has two
numbers a spelling, its 64-bit key and its ratio, so it grows with the different spellings of labelled texts, not
with their rows.

Defined results: a null text is an empty one; texts without words, and all texts when a class has no labelled
rows, get the share of toxic rows as their score; labelled texts that are equal count once, as toxic if any is
labelled so, and so do repeated labels of a doc_id; repeated rows are scored each for itself; a null doc_id is in no fold;
an empty table gives no rows; words and texts are judged whole, however long; other columns, whatever their names, are
kept by ``kept_documents`` and not read.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, in_arrow
from .labelled import fold, mapped, text_key
from .quality import keep, scaling

#: Letters of context.
ORDER = 5
#: Labelled ids are broadcast up to so many, and joined by a shuffle beyond; the rows are the same.
BROADCAST_IDS = 1_000_000
#: Words of the runs that are judged as spans; one scaling input each, beside the whole document.
SPANS = (1, 2, 16)
#: Different tokens that a worker remembers, and that a task gathers before it emits their words.
MEMO, GATHERED = 400_000, 200_000
#: Tokens whose spans are judged at once.
SLICE = 200_000
FOLDS, HELD_OUT, SCALE_FOLD, THRESHOLD = 5, 0, 4, 0.5
WORD = re.compile(r"[^\W\d_]+")
#: Letters of a piece of a long word; pieces overlap by the letters of context, so their steps are the word's.
PIECE = 200
DISCOUNT = 0.75


def words_of(tokens) -> list[str]:
    """The words in different runs of characters that aren't white space, as often as they stand in them."""
    return WORD.findall(" ".join(tokens).lower())


def pieces(word: str) -> list[str]:
    """A word between marks, in pieces of a bounded length; every piece but the first begins with its context."""
    marked = f"^{word}$"
    return [marked[max(0, i - ORDER) : i + PIECE] for i in range(0, len(marked), PIECE)] if len(marked) > PIECE else [marked]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def _keys(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the contexts and of the spellings in rows of ORDER + 1 letters, zeros before a word's mark."""
    w = [windows[:, i].astype(np.uint64) for i in range(ORDER + 1)]
    context = _mix(_mix(w[0] << np.uint64(42) | w[1] << np.uint64(21) | w[2]) + (w[3] << np.uint64(21) | w[4]))
    return context, _mix(context * np.uint64(3) + w[5])


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of the wanted ones among sorted keys, NaN for others; most are wanted many times, and looked up once."""
    if not len(keys) or not len(wanted):
        return np.full(len(wanted), np.nan)
    different, places = np.unique(wanted, return_inverse=True)
    at = np.minimum(np.searchsorted(keys, different), len(keys) - 1)
    return np.where(keys[at] == different, values[at], np.nan)[places]


def _steps(words: DataFrame) -> DataFrame:
    """Adds a row for each letter of each piece that isn't its context: the letters before it, and itself."""
    steps = F.expr(f"transform(sequence(if(startswith(piece, '^'), 1, {ORDER}), length(piece) - 1), i -> named_struct('h', substring(piece, greatest(1, i - {ORDER - 1}), least(i, {ORDER})), 'c', substring(piece, i + 1, 1)))")
    return words.withColumn("s", F.explode(steps)).select(*(c for c in words.columns if c != "piece"), "s.h", "s.c")


class Ratios:
    """Log-likelihood ratios of spellings, and the scaling of a document's evidence."""

    def __init__(self, seen: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], prior: float):
        """Sorted keys and values: seen, of spellings that a class has seen; other, of other letters after a context that it has seen."""
        self.seen, self.other, self.prior, self.scale = seen, other, prior, None

    def words(self, words: list[str]) -> np.ndarray:
        """The toxic minus the ordinary log-likelihood of each word."""
        if not words:
            return np.zeros(0)
        codes = _codes([f"{chr(0) * ORDER}^{w}$" for w in words])
        windows = np.lib.stride_tricks.sliding_window_view(codes, ORDER + 1)
        windows = windows[(windows[:, -1] != 0) & (windows[:, -1] != ord("^"))]
        contexts, steps = _keys(windows)
        ratios = _looked_up(*self.seen, steps)
        new = np.isnan(ratios)
        ratios[new] = np.nan_to_num(_looked_up(*self.other, contexts[new]))
        return np.bincount(np.repeat(np.arange(len(words)), [len(w) + 1 for w in words]), ratios, len(words))

    def tokens(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed evidence of each token's words, and their letters, marks of their ends included."""
        found = [WORD.findall(t) for t in " ".join(tokens).lower().split(" ")] if tokens else []
        flat = [w for own in found for w in own]
        owner = np.repeat(np.arange(len(tokens)), [len(own) for own in found])
        return np.bincount(owner, self.words(flat), len(tokens)), np.bincount(owner, [len(w) + 1 for w in flat], len(tokens))

    def evidence(self, texts: list[str | None], judge: "Judge") -> np.ndarray:
        """Rows of inputs: of the whole document, of the best run of each length, and 1 if there is a word."""
        out, part, size = [np.zeros((0, len(SPANS) + 2))], [], 0
        for text in texts:
            part.append((text or "").split())
            size += len(part[-1])
            if size >= SLICE:
                out.append(judge.spans(part))
                part, size = [], 0
        return np.concatenate([*out, judge.spans(part)])

    def score(self, texts: list[str | None], judge: "Judge") -> np.ndarray:
        if self.scale is None:
            return np.full(len(texts), self.prior)
        x = self.evidence(texts, judge)
        z = x[:, :-1] @ np.array(self.scale[:-1]) + self.scale[-1]
        # rounded, for the last digits of a sum depend on how rows are batched
        return np.where(x[:, -1] > 0, np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 9), self.prior)


class Places(dict):
    """Numbers of tokens, in the order in which they come."""

    def __missing__(self, token: str) -> int:
        place = self[token] = len(self)
        return place


class Judge:
    """Evidence of tokens, remembered up to a bound by their places in two growing arrays."""

    def __init__(self, model: Ratios):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.places = Places()
        self.sums, self.letters = np.zeros(0), np.zeros(0)

    def spans(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.places) > MEMO:
            self.forget()
        known = len(self.places)
        flat = [t for own in texts for t in own]
        places = np.fromiter(map(self.places.__getitem__, flat), np.int64, len(flat))
        if len(self.places) > known:
            sums, letters = self.model.tokens([*islice(reversed(self.places), len(self.places) - known)][::-1])
            self.sums, self.letters = np.r_[self.sums, sums], np.r_[self.letters, letters]
        sums, letters = self.sums[places], self.letters[places]
        # tokens without a word are no part of a run
        worded = letters > 0
        owner = np.repeat(np.arange(len(texts)), [len(own) for own in texts])[worded]
        total, size = (np.r_[0.0, np.cumsum(x[worded])] for x in (sums, letters))
        ends = np.searchsorted(owner, np.arange(len(texts)), "right")
        starts = np.r_[0, ends[:-1]]
        some = ends > starts
        out = np.zeros((len(texts), len(SPANS) + 2))
        out[:, -1] = some
        if some.any():
            out[some, 0] = (total[ends] - total[starts])[some] / (size[ends] - size[starts])[some]
            for k, width in enumerate(SPANS, 1):
                # a run begins at each word; near a document's end it is shorter
                last = np.minimum(np.arange(len(owner)) + width, ends[owner])
                runs = (total[last] - total[:-1]) / np.maximum(size[last] - size[:-1], 1)
                short = last - np.arange(len(owner)) < np.minimum(width, (ends - starts)[owner])
                out[some, k] = np.maximum.reduceat(np.where(short, -np.inf, runs), starts[some])
        return out


def _emitted(counts: dict[int, Counter], classes: bool) -> pa.RecordBatch:
    rows = [(p, t, n) for t, counted in counts.items() for w, n in counted.items() for p in pieces(w)]
    columns = [*zip(*rows)] or [(), (), ()]
    names, kinds = ["piece", "toxic", "n"], (pa.string(), pa.int32(), pa.int64())
    chosen = range(3) if classes else range(1)
    return pa.RecordBatch.from_arrays([pa.array(columns[i], kinds[i]) for i in chosen], [names[i] for i in chosen])


def _corpus_words(batches):
    """Pieces of the different words of all texts, those of a bounded number of tokens at a time."""
    tokens: set[str] = set()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            tokens.update((text or "").split())
            if len(tokens) >= GATHERED:
                yield _emitted({0: Counter({*words_of(tokens)})}, classes=False)
                tokens = set()
    yield _emitted({0: Counter({*words_of(tokens)})}, classes=False)


def _class_words(batches):
    """Pieces of words and classes, with the number of texts of the class that hold the word."""
    counts = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[toxic].update({*words_of({*(text or "").split()})})
            if len(counts[toxic]) >= GATHERED:
                yield _emitted(counts, classes=True)
                counts = {0: Counter(), 1: Counter()}
    yield _emitted(counts, classes=True)


def corpus_continuations(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of wanted (h, c): how many distinct longer contexts of the whole corpus continue h by c, and h's sums."""
    words = in_arrow(documents.select("text"), _corpus_words, "piece string")
    full = _steps(words.distinct()).distinct()
    # every shorter context of a step is continued once for each distinct full one
    lower = full.withColumn("k", F.explode(F.sequence(F.lit(0), F.length("h") - 1))).select(F.expr("substring(h, length(h) - k + 1, k)").alias("h"), "c")
    counts = checkpointed(lower.groupBy("h", "c").agg(F.count("*").alias("n")))
    sums = counts.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    return counts.join(wanted, ["h", "c"], "left_semi").join(sums, "h")


def labelled_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic and scales of the labelled rows of the training folds, one for each different text."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    train = checkpointed(known.filter(fold("doc_id", FOLDS) != HELD_OUT).withColumn("scales", fold("doc_id", FOLDS) == SCALE_FOLD))
    digest = text_key().alias("digest")
    # a text that is also counted doesn't scale
    by_text = _joined(documents, train).select("doc_id", digest, "toxic", "scales").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.min("scales").alias("scales"))
    return checkpointed(by_text.drop("digest"))


def _joined(documents: DataFrame, ids: DataFrame) -> DataFrame:
    few = ids.count() <= BROADCAST_IDS
    return documents.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id")


def class_counts(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """h, c, and of each class how many distinct words of distinct counted texts hold the spelling: n0, n1."""

    counted = _joined(documents, rows.filter("NOT scales")).select("text", "toxic")
    words = in_arrow(counted, _class_words, "piece string, toxic int, n long")
    of = lambda k: F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).alias(f"n{k}")
    by_word = words.groupBy("piece").agg(of(0), of(1))
    return checkpointed(_steps(by_word).groupBy("h", "c").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


def backed_off(documents: DataFrame, steps: DataFrame) -> DataFrame:
    """h, c and base, the shared model's probability of c after h without its first letter."""
    suffixes = F.explode(F.expr("transform(sequence(0, length(h) - 1), k -> substring(h, length(h) - k + 1, k))")).alias("h")
    shared = checkpointed(corpus_continuations(documents, steps.select(suffixes, "c").distinct()))
    # from the empty context up, each level backs off to the one below
    levels = []
    for k in range(ORDER):
        level = shared.filter(F.length("h") == k).withColumn("b", F.lit(1 / 256))
        if k:
            level = level.drop("b").withColumn("shorter", F.expr("substring(h, 2)")).join(levels[-1].select(F.col("h").alias("shorter"), "c", F.col("p").alias("b")), ["shorter", "c"])
        levels.append(level.select("h", "c", F.expr(f"(greatest(n - {DISCOUNT}D, 0D) + {DISCOUNT}D * kinds * b) / total").alias("p")))
    below = levels[0]
    for level in levels[1:]:
        below = below.unionByName(level)
    return steps.select("h", "c", F.expr("substring(h, 2)").alias("shorter")).join(below.select(F.col("h").alias("shorter"), "c", F.col("p").alias("base")), ["shorter", "c"]).drop("shorter")


def _table(df: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and values of rows (text, v): 16 bytes a row reach the driver."""
    contexts = text == "h"

    def keyed(texts, values):
        if not texts:
            return ()
        padded = [(t + "\0" if contexts else t).rjust(ORDER + 1, "\0") for t in texts]
        keys = _keys(_codes(padded).reshape(-1, ORDER + 1))[0 if contexts else 1]
        return zip(keys.view(np.int64).tolist(), values)

    found = mapped(df.select(text, "v"), keyed, "k long, v double", {"k": pa.int64(), "v": pa.float64()}).toArrow()
    keys = found["k"].to_numpy().view(np.uint64)
    order = np.argsort(keys, kind="stable")
    return keys[order], found["v"].to_numpy()[order]


def ratios(documents: DataFrame, steps: DataFrame, prior: float) -> Ratios:
    sums = steps.agg(*(F.count_if(F.col(f"n{k}") == m) for k in (0, 1) for m in (1, 2))).first()  # one row
    discounts = [ones / (ones + 2 * twos) if ones else DISCOUNT for ones, twos in (sums[:2], sums[2:])]
    contexts = steps.groupBy("h").agg(*(x for k in (0, 1) for x in (F.sum(f"n{k}").alias(f"total{k}"), F.count_if(F.col(f"n{k}") > 0).alias(f"kinds{k}"))))
    for k in (0, 1):
        contexts = contexts.withColumn(f"share{k}", F.expr(f"if(total{k} > 0, {discounts[k]!r}D * kinds{k} / total{k}, 1D)"))
    contexts = checkpointed(contexts.withColumn("v", F.expr("ln(share1 / share0)")))
    rows = steps.join(contexts.drop("v"), "h").join(backed_off(documents, steps), ["h", "c"])
    for k in (0, 1):
        rows = rows.withColumn(f"p{k}", F.expr(f"if(total{k} > 0, greatest(n{k} - {discounts[k]!r}D, 0D) / total{k} + share{k} * base, base)"))
    return Ratios(_table(rows.select(F.concat("h", "c").alias("spelling"), F.expr("ln(p1 / p0)").alias("v")), "spelling"), _table(contexts, "h"), prior)


def fit(documents: DataFrame, labels: DataFrame) -> Ratios:
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r.toxic: r["count"] for r in known.filter(fold("doc_id", FOLDS) != HELD_OUT).groupBy("toxic").count().collect()}
    prior = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    rows = labelled_rows(documents, labels)
    kinds = {(r.toxic, r.scales) for r in rows.select("toxic", "scales").distinct().collect()}  # four at most
    steps = class_counts(documents, rows)
    if len(kinds) < 4 or not all(steps.agg(F.sum("n0"), F.sum("n1")).first()):
        nothing = np.zeros(0, np.uint64), np.zeros(0)
        return Ratios(nothing, nothing, prior)
    model = ratios(documents, steps, prior)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def evidence(texts, toxic):
        return ((*x, t) for x, t in zip(sent.value.evidence(texts, Judge(sent.value)).tolist(), toxic))

    names = ["whole", *(f"run{n}" for n in SPANS), "some"]
    held = mapped(_joined(documents, rows.filter("scales")).select("text", "toxic"), evidence, ", ".join(f"{x} double" for x in names) + ", toxic int", {x: pa.float64() for x in names} | {"toxic": pa.int32()}).toArrow()
    sent.destroy()
    held = held.filter(pc.greater(held["some"], 0))
    y = held["toxic"].to_numpy()
    share = np.array([1 - prior, prior])
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    if not n.all():
        return model
    # equal texts count once; weights give the classes back their shares
    weight = (share * len(y) / n)[y]
    target = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    model.scale = scaling(np.stack([held[x].to_numpy() for x in names[:-1]], 1), target, weight)
    return model


def score_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    sent = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))
    judges: list[Judge] = []

    def run(keys, held, texts):
        scores = sent.value.score(texts, _judge(judges, sent)).tolist()
        return ((k, h, s, int(s >= THRESHOLD)) for k, h, s in zip(keys, held, scores))

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return mapped(rows, run, "doc_id long, held_out boolean, score double, predicted int", {"doc_id": pa.int64(), "held_out": pa.bool_(), "score": pa.float64(), "predicted": pa.int32()})


def kept_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with the columns they had."""
    sent = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))
    judges: list[Judge] = []
    return keep(documents, sent, lambda m: (lambda texts: m.value.score(texts, _judge(judges, m)) < THRESHOLD))


def _judge(judges: list[Judge], sent) -> Judge:
    """The judge of this task."""
    if not judges:
        judges.append(Judge(sent.value))
    return judges[0]

"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The
probability of a word is the sum over all its segmentations into pieces, found by the
forward algorithm; a text's is the product over its words. Piece probabilities are
fitted by expectation maximisation (forward and backward sums) on training texts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.frames import memory, pieces
from gridloom.session import ship

VOCABULARY = "piece_bpe_32k.model"
#: Training rows to fit on; chosen by a hash of the id from all training rows.
TRAIN_ROWS = 2_000
#: Rows that a language gets at least, if it has as many.
LANGUAGE_ROWS = 30
ROUNDS, SMOOTHING = 4, 0.02
#: Words up to so many letters are fitted side by side with plain sums; longer ones, whole as well, in logarithms.
PLAIN = 32
#: Positions between rescalings of forward sums; words up to TOGETHER letters are scored side by side.
RESCALE, TOGETHER, LONG_STEP = 16, 64, 4096
#: Tokens that a worker remembers, and the longest such token in bytes.
CACHE_ENTRIES, CACHED_BYTES = 700_000, 128
UNDETERMINED = "und"
_RUNS = re.compile(r"[^\W\d_]+")
_START = "▁"


def vocabulary(name: str = VOCABULARY) -> dict[str, int]:
    """Lower-case letter pieces, with or without the mark of a word's start."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    fits = (p for p in found if (p.removeprefix(_START)).isalpha() and p == p.lower())
    return {p: i for i, p in enumerate(dict.fromkeys(fits))}


def letter_runs(text: str) -> list[str]:
    """Runs of letters, which are the characters of which ``str.isalpha`` holds."""
    if text.isalpha():
        return [text]
    found = []
    for run in _RUNS.findall(text):
        # The pattern also takes numbers that are no digits, like a half.
        found += [run] if run.isalpha() else ["".join(part) for letter, part in groupby(run, str.isalpha) if letter]
    return found


def has_letter(text: str) -> bool:
    return any(c.isalpha() for run in _RUNS.finditer(text) for c in run[0])


def marked_words(token: str) -> list[str]:
    """The lower-case letter runs of a token, marked as word starts."""
    return [_START + run for run in letter_runs(token.lower())]


@dataclass
class Model:
    """Piece probabilities: a column for each language; the last two rows are for unknown letters and for none."""

    langs: list[str]
    pieces: dict[str, int]
    probs: np.ndarray

    def __post_init__(self) -> None:
        self.trie = Trie(self.pieces)


class Trie:
    """The pieces' beginnings as states; 0 is where none begins like that.

    Few letters occur in pieces of several letters: these have columns of ``next``. The others lead on
    only from a piece's start, or from the mark of a word's start.
    """

    def __init__(self, pieces_of: dict[str, int]) -> None:
        self.longest = max(map(len, pieces_of), default=1)
        begins = {p[:size] for p in pieces_of for size in range(1, len(p) + 1)}
        states = {p: i for i, p in enumerate(sorted(begins), 1)}
        inner = sorted({c for p in pieces_of if len(p.removeprefix(_START)) > 1 for c in p.removeprefix(_START)})
        letters = {c: i for i, c in enumerate(inner + sorted(set("".join(pieces_of)) - set(inner)), 1)}
        self.columns = len(inner) + 1
        self.codes = np.zeros(0x110000, np.int32)
        self.codes[[ord(c) for c in letters]] = list(letters.values())
        self.number = np.full(len(states) + 1, -1, np.int32)
        self.first, self.marked = (np.zeros(len(letters) + 1, np.int32) for _ in range(2))
        self.next = np.zeros((len(states) + 1, self.columns), np.int32)
        for p, state in states.items():
            self.number[state] = pieces_of.get(p, -1)
            if len(p) == 1:
                self.first[letters[p]] = state
            elif letters[p[-1]] < self.columns:
                self.next[states[p[:-1]], letters[p[-1]]] = state
            if len(p) == 2 and p[0] == _START:
                self.marked[letters[p[1]]] = state

    def lattice(self, words: list[str]) -> np.ndarray:
        """Piece numbers [word, start, length - 1] of words of equal length; -1: none, -2: an unknown letter."""
        n = len(words[0])
        codes = self.codes[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)].reshape(len(words), n)
        out = np.full((len(words), n, min(n, self.longest)), -1, np.int32)
        state = self.first[codes]
        out[:, :, 0] = np.where(self.number[state] >= 0, self.number[state], -2)
        word, start = np.nonzero(state)
        state = state[word, start]
        for size in range(2, min(n, self.longest) + 1):
            inside = start + size <= n
            word, start, state = word[inside], start[inside], state[inside]
            code = codes[word, start + size - 1]
            after = np.where(code < self.columns, self.next[state, np.minimum(code, self.columns - 1)], 0)
            if size == 2:
                after = np.where((start == 0) & (codes[word, 0] == self.codes[ord(_START)]), self.marked[code], after)
            goes = after > 0
            word, start, state = word[goes], start[goes], after[goes]
            if not len(state):
                break
            out[word, start, size - 1] = self.number[state]
        return out


def _forward(lattice: np.ndarray, probs: np.ndarray, scale: np.ndarray | None = None) -> np.ndarray:
    """alpha[position, word, language]: the sum over all segmentations up to there.

    With ``scale``, sums are divided by their largest now and then; its logarithm is added to scale[word, language].
    """
    words, n, longest = lattice.shape
    alpha = np.zeros((n + 1, words, probs.shape[1]))
    alpha[0] = 1
    for start in range(n):
        if scale is not None and start and start % RESCALE == 0:
            ahead = alpha[start : start + longest]  # all that the rest depends on
            most = ahead.max(axis=0)
            ahead /= most
            scale += np.log(most)
        for size in range(1, min(longest, n - start) + 1):
            own = lattice[:, start, size - 1]
            some = np.flatnonzero(own != -1)
            if len(some) == words:
                alpha[start + size] += alpha[start] * probs[own]
            elif len(some):
                alpha[start + size, some] += alpha[start, some] * probs[own[some]]
    return alpha


def _log_prob(word: str, model: Model) -> np.ndarray:
    """The forward algorithm for one long word, in a window of the longest piece."""
    get, longest, langs = model.pieces.get, model.trie.longest, len(model.langs)
    rows = model.probs.tolist()
    ahead = [[0.0] * langs for _ in range(longest + 1)]  # ahead[k]: the sum up to k letters from here
    ahead[0] = [1.0] * langs
    logs = np.zeros(langs)
    for begin in range(0, len(word), LONG_STEP):
        part = word[begin : begin + LONG_STEP + longest]
        for start in range(min(LONG_STEP, len(word) - begin)):
            here = ahead[0]
            for size in range(1, min(longest, len(part) - start) + 1):
                piece = get(part[start : start + size], -2 if size == 1 else -1)
                if piece != -1:
                    ahead[size] = [x + y * z for x, y, z in zip(ahead[size], here, rows[piece], strict=True)]
            del ahead[0]
            ahead.append([0.0] * langs)
            if start % RESCALE == 0:
                most = [max(x) for x in zip(*ahead, strict=True)]
                logs += np.log(most)
                ahead = [[x / y for x, y in zip(row, most, strict=True)] for row in ahead]
    return np.log(np.maximum(ahead[0], 1e-300)) + logs


def _by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Places of words of equal length, a bounded number at a time."""
    groups: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        groups[len(w)].append(i)
    for group in groups.values():
        for at in range(0, len(group), 4096):
            yield np.array(group[at : at + 4096])


def log_probs(words: list[str], model: Model) -> np.ndarray:
    """Logarithms of the words' probabilities, each the sum over all segmentations, for each language."""
    out = np.empty((len(words), len(model.langs)))
    short = [i for i, w in enumerate(words) if len(w) <= TOGETHER]
    for own in _by_length([words[i] for i in short]):
        own = np.array(short)[own]
        lattice = model.trie.lattice([words[i] for i in own])
        scale = np.zeros((len(own), len(model.langs)))
        out[own] = np.log(np.maximum(_forward(lattice, model.probs, scale)[-1], 1e-300)) + scale
    for i, word in enumerate(words):
        if len(word) > TOGETHER:
            out[i] = _log_prob(word, model)
    return out


def _log_sum(x: np.ndarray) -> np.ndarray:
    most = x.max(axis=0)
    return most + np.log(np.exp(x - most).sum(axis=0))


def _expect_long(word: str, weight: np.ndarray, trie: Trie, probs: np.ndarray, found: np.ndarray) -> None:
    """Add to ``found`` how often each piece is expected in a long word, over all its segmentations.

    Forward and backward sums are logarithms, so words of any length have them; 8 bytes a letter and language are kept, and
    pieces are looked up LONG_STEP letters at a time.
    """
    n, longest, langs = len(word), trie.longest, probs.shape[1]
    with np.errstate(divide="ignore"):
        logs = np.log(probs)

    def steps(begin: int) -> np.ndarray:
        """Piece numbers [start, length - 1] of the pieces that start in LONG_STEP letters."""
        size = min(LONG_STEP, n - begin)
        out = np.full((size, longest), -1, np.int32)
        lattice = trie.lattice([word[begin : begin + size + longest - 1]])[0][:size]
        out[:, : lattice.shape[1]] = lattice
        return out

    ahead = np.full((n + longest, langs), -np.inf)  # at the end of each piece, as if no letter followed it
    ahead[0] = 0
    for begin in range(0, n, LONG_STEP):
        own = steps(begin)
        for at, row in enumerate(logs[own], begin):
            ahead[at + 1 : at + 1 + longest] = np.logaddexp(ahead[at + 1 : at + 1 + longest], ahead[at] + row)
    total = ahead[n]
    back = np.full((longest, langs), -np.inf)  # of the next letters' starts, the nearest first
    back[0] = 0
    for begin in range((n - 1) // LONG_STEP * LONG_STEP, -1, -LONG_STEP):
        own = steps(begin)
        rows = logs[own]
        for at in range(len(own) - 1, -1, -1):
            row = rows[at] + back
            rows[at] = row
            back[1:] = back[:-1]
            back[0] = _log_sum(row)
        share = np.exp(ahead[begin : begin + len(own), None] + rows - total) * weight
        some = own != -1
        np.add.at(found, own[some], share[some])


def fit(counts: dict[str, Counter], pieces_of: dict[str, int], rounds: int = ROUNDS) -> Model:
    """Piece probabilities for each language from its words' counts."""
    langs = sorted(counts)
    words = sorted(set().union(*counts.values())) if counts else []
    weights = np.array([[counts[lang][w] for lang in langs] for w in words], float).reshape(len(words), len(langs))
    size = len(pieces_of)
    # Rows size (unknown letter, index -2) and size + 1 (no piece, index -1, probability 0).
    probs = np.full((size + 2, len(langs)), 1.0 / (size + 1))
    probs[-1] = 0
    trie = Trie(pieces_of)
    plain = np.array([i for i, w in enumerate(words) if len(w) <= PLAIN + 1], int)
    lattices = [(plain[own], trie.lattice([words[plain[i]] for i in own])) for own in _by_length([words[i] for i in plain])]
    long = [i for i, w in enumerate(words) if len(w) > PLAIN + 1]
    for _ in range(rounds):
        found = np.zeros_like(probs)
        for i in long:
            _expect_long(words[i], weights[i], trie, probs, found)
        for own, lattice in lattices:
            alpha = _forward(lattice, probs)
            n = lattice.shape[1]
            beta = np.zeros_like(alpha)
            beta[n] = weights[own] / np.maximum(alpha[n], 1e-300)
            for start in range(n - 1, -1, -1):
                for length in range(1, min(trie.longest, n - start) + 1):
                    some = np.flatnonzero(lattice[:, start, length - 1] != -1)
                    if not len(some):
                        continue
                    piece = lattice[some, start, length - 1]
                    share = probs[piece] * beta[start + length, some]
                    beta[start, some] += share
                    np.add.at(found, piece, alpha[start, some] * share)
        found[-1] = 0
        probs = (found + SMOOTHING) / (found.sum(axis=0) + SMOOTHING * (size + 1))
        probs[-1] = 0
    return Model(langs, pieces_of, probs)


def bucket(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def quotas(sizes: dict[str, int], train_rows: int) -> dict[str, float]:
    """Rows for each language: equal parts of ``train_rows``; what small languages leave goes to larger ones."""
    out, left = {}, float(train_rows)
    for n, (lang, size) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(float(size), max(LANGUAGE_ROWS, left / (len(sizes) - n)))
        left -= out[lang]
    return out


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    train_rows: int = TRAIN_ROWS,
    vocabulary_name: str = VOCABULARY,
) -> Model:
    """Fit on at most about ``train_rows`` rows with a language, outside the held-out fold.

    The sample is, for each language, a fixed share of a hash of the id, so its words, summed in Spark,
    are bounded too. Every language with a training row is in it; with many languages LANGUAGE_ROWS
    of each may be more than ``train_rows``. Rows without id, text or language teach nothing; without any training row the
    model knows no language.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & (bucket("id") != 0))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    langs = {r["lang"]: r for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least")).collect()}
    if sum(r["n"] for r in langs.values()) > train_rows:
        # The row of the least hash is always in, as rows of one id share their hash.
        limits = [(
            lang,
            max(int((1 << 30) * rows_of / langs[lang]["n"]), langs[lang]["least"] + 1),
        ) for lang, rows_of in quotas({k: r["n"] for k, r in langs.items()}, train_rows).items()]
        rows = rows.join(
            F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, _limit long")),
            "lang",
        ).where(place < F.col("_limit"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                for token, n in Counter((text or "").split()).items():
                    for word in marked_words(token):
                        seen[lang, word] += n
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in seen], pa.string()),
                pa.array([k[1] for k in seen], pa.string()),
                pa.array(list(seen.values()), pa.int64()),
            ],
            ["lang", "word", "n"],
        )

    sums = rows.select("text", "lang").mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = defaultdict(Counter)
    table = sums.toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    for lang, word, n in zip(*(table[c].to_pylist() for c in ("lang", "word", "n")), strict=True):
        counts[lang][word] = n
    return fit(counts, vocabulary(vocabulary_name))


class Scorer:
    """Sums of log probabilities of texts; remembers tokens."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.used = 0
        self.rows = np.zeros((1 << 16, len(self.model.langs)))

    def learn(self, tokens: list[bytes]) -> None:
        place, parts, owners = self.place, [], []
        for at, token in enumerate(tokens, self.used):
            own = marked_words(token.decode("utf-8", "replace"))
            place[token] = at
            parts += own
            owners += [at] * len(own)
        self.used += len(tokens)
        while self.used > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        distinct = list(dict.fromkeys(parts))
        if distinct:
            index = {w: i for i, w in enumerate(distinct)}
            np.add.at(self.rows, owners, log_probs(distinct, self.model)[[index[p] for p in parts]])

    def score(self, texts: pa.Array) -> np.ndarray:
        """Texts (null: empty) -> sums [text, language]."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        at = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        tokens = coded.dictionary.cast(pa.binary()).to_pylist()
        if self.used > CACHE_ENTRIES:
            self.clear()
        new = [t for t in tokens if t not in self.place]
        if new:
            self.learn(new)
        own = self.rows[np.fromiter(map(self.place.__getitem__, tokens), np.int64, len(tokens))]
        for token in new:
            if len(token) > CACHED_BYTES:
                del self.place[token]
        out = np.zeros((len(texts), len(self.model.langs)))
        some = np.flatnonzero(np.diff(at))
        if len(some):
            out[some] = np.add.reduceat(own[coded.indices.to_numpy()], at[some] - at[0], axis=0)
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior under equal priors.

        Text that is null or has no letter is undetermined with score 0, as is any text for
        a model without languages; ties go to the first language in order.
        """
        plain = pc.fill_null(pc.match_substring_regex(texts, "[A-Za-z]"), False).to_pylist()
        letters = np.array([p or has_letter(texts[i].as_py() or "") for i, p in enumerate(plain)], bool)
        if not self.model.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        sums = self.score(texts)
        best = sums.argmax(axis=1)
        posterior = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        names = [self.model.langs[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        return names, np.where(letters, posterior, 0.0)


_scorers: dict[int, Scorer] = {}


def forget() -> None:
    """Drop this worker's scorers; a function, as a closure would carry a copy of the table."""
    _scorers.clear()


def _scorer(shared) -> Scorer:
    if shared.id not in _scorers:
        _scorers.clear()
        _scorers[shared.id] = Scorer(shared.value)
    return _scorers[shared.id]


class _Shared:
    """A broadcast model with a number by which workers know it."""

    def __init__(self, spark, model: Model) -> None:
        self.held = spark.sparkContext.broadcast(model)
        self.id = self.held._jbroadcast.id()

    def __getstate__(self):
        return {"held": self.held, "id": self.id}

    @property
    def value(self) -> Model:
        return self.held.value


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score.

    Null, empty and letterless texts are ``und`` with score 0, as is every text for a model that
    knows no language; equally likely languages go to the first by name. Texts are read whole,
    however long. Rows that repeat an id, and rows with a null id, are predicted each for itself. Other columns are not
    read, whatever their names. An empty table gives no rows.
    """
    shared = _Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 512):
            with memory("language_id", forget):
                names, scores = _scorer(shared).predict(batch["text"].cast(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text has a language at ``min_score`` or above, all columns unchanged.

    Null, empty and letterless texts go, as do all for a model that knows no language. Each row is
    judged by its text alone, so repeated rows and null ids stay or go alike. An empty table stays empty.
    """
    shared = _Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 512):
            with memory("language_id", forget):
                names, scores = _scorer(shared).predict(batch[text_col].cast(pa.string()))
            yield batch.filter(pa.array(
                [n != UNDETERMINED and s >= min_score for n, s in zip(names, scores.tolist(), strict=True)],
                pa.bool_(),
            ))

    return docs.mapInArrow(run, docs.schema)

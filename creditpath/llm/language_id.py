"""Language identification by piece unigrams that sum over all segmentations.

A public vocabulary of pieces is fixed; each language has a probability for each piece,
learned by expectation-maximisation. The probability of a word is the sum over all its
segmentations into pieces, by the forward algorithm; a text is the product of its words.
Pieces may have any length and words too: sums over long words are rescaled on their way.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditpath.llm.common import crc_of, hinted, stash

# Most documents of a fit for each language, chosen by a hash of doc_id.
SAMPLE_ROWS = 2_000
HELD_OUT = (4, 2)  # crc32(doc_id) mod 4 = 2 is held out
ROUNDS, PSEUDO = 3, 0.05
# Words of more letters are summed one at a time and with rescaling, and are not remembered.
LONG_WORD = 32
# Probability of a character that no piece covers, the same in every language.
UNKNOWN = 1e-7
# Words whose probabilities a worker remembers; then it starts anew.
REMEMBERED = 400_000
# A letter, then letters and the marks that combine with them.
_RUN = regex.compile(r"\p{L}[\p{L}\p{M}]*")
START = "▁"


def vocabulary(path: str | None = None) -> list[str]:
    """The letter pieces of a public sentence-piece model in lower case; ``path`` is its file."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("piece_bpe_32k.model"))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    letters = regex.compile(r"[\p{L}\p{M}]+")
    return sorted(p for p in pieces if p == START or letters.fullmatch(p.removeprefix(START)))


def words_of(text: str | None) -> list[str]:
    return _RUN.findall(text.lower()) if text else []


class Segmenter:
    """Piece numbers of all segmentations, for many words of one length at a time."""

    def __init__(self, pieces: list[str]):
        self.number = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self.unknown, self.none = len(pieces), len(pieces) + 1

    def lattice(self, words: list[str]) -> np.ndarray:
        """[word, end, length - 1]: the piece of that length ending there, for words of equal length."""
        n, get, none, unknown = len(words[0]), self.number.get, self.none, self.unknown
        reach = min(n, self.longest)
        rows = [
            [get(w[j - k : j], unknown if k == 1 else none) if k <= j else none for j in range(1, n + 1) for k in range(1, reach + 1)]
            for w in words
        ]
        return np.array(rows, dtype=np.int32).reshape(len(words), n, reach)

    def table(self, probabilities: np.ndarray) -> np.ndarray:
        """Rows for the unknown character and for no piece below those of the pieces."""
        extra = np.zeros((2, probabilities.shape[1]))
        extra[0] = UNKNOWN
        return np.vstack([probabilities, extra])

    def forward(self, lattice: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[end, word, language]: the sum over all segmentations up to there, as a number and the logarithm of its scale."""
        words, n, reach = lattice.shape
        alpha = np.zeros((n + 1, words, table.shape[1]))
        scale = np.zeros_like(alpha)
        alpha[0] = 1
        for j in range(1, n + 1):
            near = min(j, reach)
            if n > LONG_WORD:
                # Against the scale of the end before; later ends carry on with what is left.
                scale[j] = scale[j - 1]
                for k in range(1, near + 1):
                    alpha[j] += alpha[j - k] * np.exp(scale[j - k] - scale[j]) * table[lattice[:, j - 1, k - 1]]
                scale[j] += np.log(alpha[j])
                alpha[j] = 1
            else:
                for k in range(1, near + 1):
                    alpha[j] += alpha[j - k] * table[lattice[:, j - 1, k - 1]]
        return alpha, scale

    def backward(self, lattice: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from an end to the word's end."""
        words, n, reach = lattice.shape
        beta = np.zeros((n + 1, words, table.shape[1]))
        scale = np.zeros_like(beta)
        beta[n] = 1
        for i in range(n - 1, -1, -1):
            near = min(n - i, reach)
            if n > LONG_WORD:
                scale[i] = scale[i + 1]
                for k in range(1, near + 1):
                    beta[i] += beta[i + k] * np.exp(scale[i + k] - scale[i]) * table[lattice[:, i + k - 1, k - 1]]
                scale[i] += np.log(beta[i])
                beta[i] = 1
            else:
                for k in range(1, near + 1):
                    beta[i] += beta[i + k] * table[lattice[:, i + k - 1, k - 1]]
        return beta, scale

    def long_word(self, word: str, table: np.ndarray) -> np.ndarray:
        """[language] of one word of any length; holds as many ends as the longest piece has letters."""
        get, word = self.number.get, START + word
        ends: deque[tuple[np.ndarray, np.ndarray]] = deque([(np.ones(table.shape[1]), np.zeros(table.shape[1]))], self.longest)
        for j in range(1, len(word) + 1):
            base = ends[-1][1]
            total = np.zeros(table.shape[1])
            for k, (value, scale) in enumerate(reversed(ends), 1):
                piece = get(word[j - k : j], self.unknown if k == 1 else None)
                if piece is not None:
                    total += value * np.exp(scale - base) * table[piece]
            ends.append((np.ones_like(total), base + np.log(total)))
        return ends[-1][1]

    def by_length(self, words: list[str], block: int = 4096) -> Iterator[tuple[list[int], list[str]]]:
        """Places and marked words, in blocks of equal length."""
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault(len(w), []).append(i)
        for places in groups.values():
            step = max(1, block * LONG_WORD // max(LONG_WORD, len(words[places[0]])))
            for at in range(0, len(places), step):
                part = places[at : at + step]
                yield part, [START + words[i] for i in part]

    def log_probabilities(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """[word, language]: the logarithm of the sum over all segmentations."""
        out = np.empty((len(words), table.shape[1]))
        for places, marked in self.by_length(words):
            alpha, scale = self.forward(self.lattice(marked), table)
            out[places] = np.log(alpha[-1]) + scale[-1]
        return out

    def expected(self, words: list[str], counts: np.ndarray, table: np.ndarray) -> np.ndarray:
        """[piece, language]: how often each piece is used, given how often each word occurs in each language."""
        out = np.zeros_like(table)
        for places, marked in self.by_length(words):
            lattice = self.lattice(marked)
            (alpha, up), (beta, down) = self.forward(lattice, table), self.backward(lattice, table)
            share = counts[places] / alpha[-1]
            for j in range(1, lattice.shape[1] + 1):
                for k in range(1, min(j, lattice.shape[2]) + 1):
                    ids = lattice[:, j - 1, k - 1]
                    used = ids != self.none
                    if used.any():
                        uses = alpha[j - k] * table[ids] * beta[j] * share
                        if lattice.shape[1] > LONG_WORD:
                            uses = uses * np.exp(up[j - k] + down[j] - up[-1])
                        np.add.at(out, ids[used], uses[used])
        return out


def _word_counts(sample: DataFrame) -> DataFrame:
    """(lang, word, n) of a sample (text, lang)."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            seen: Counter = Counter()
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                seen.update((lang, w) for w in words_of(text))
            langs, words = zip(*seen) if seen else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(seen.values(), pa.int64())],
                ["lang", "word", "n"],
            )

    counted = sample.select("text", "lang").mapInArrow(batches, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _expected(counts: DataFrame, pieces: list[str], langs: list[str], probabilities: np.ndarray) -> DataFrame:
    """(piece, lang, n): the expected uses of each piece."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter, place = Segmenter(pieces), {lang: i for i, lang in enumerate(langs)}
        table = segmenter.table(probabilities)
        total = np.zeros_like(table)
        for part in parts:
            words = part.column(1).to_pylist()
            known = {w: i for i, w in enumerate(dict.fromkeys(words))}
            seen = np.zeros((len(known), len(langs)))
            for lang, word, n in zip(part.column(0).to_pylist(), words, part.column(2).to_pylist()):
                seen[known[word], place[lang]] += n
            if known:
                total += segmenter.expected(list(known), seen, table)
        piece, lang = np.nonzero(total[: len(pieces)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece, pa.int64()), pa.array(lang, pa.int64()), pa.array(total[piece, lang], pa.float64())],
            ["piece", "lang", "n"],
        )

    each = counts.select("lang", "word", "n").mapInArrow(batches, "piece long, lang long, n double")
    return each.groupBy("piece", "lang").agg(F.sum("n").alias("n"))


def fit(documents: DataFrame, pieces: list[str], sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """The learned languages and [piece, language] probabilities, from at most ``sample_rows`` documents a language.

    Languages times pieces numbers come to the driver.
    """
    learned = F.pmod(crc_of(F.col("doc_id")), F.lit(HELD_OUT[0])) != HELD_OUT[1]
    usable = documents.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & learned).select("doc_id", "text", "lang")
    counts = usable.groupBy(F.col("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("_n"))
    # A hash cut that some more rows pass than are wanted, so that no task orders the rows of a whole language.
    enough = sample_rows + 10 * sample_rows**0.5 + 100
    place = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    near = usable.join(hinted(counts), F.col("lang") == F.col("_lang")).where(place * F.col("_n") < enough)
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    sample = near.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= sample_rows).select("text", "lang")
    counts = stash(_word_counts(sample), "words")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    probabilities = np.full((len(pieces), len(langs)), 1 / len(pieces))
    for _ in range(ROUNDS if langs else 0):
        found = np.full_like(probabilities, PSEUDO)
        for row in _expected(counts, pieces, langs, probabilities).toPandas().itertuples(index=False):
            found[row.piece, row.lang] += row.n
        probabilities = found / found.sum(0)
    return langs, probabilities


def identified(
    documents: DataFrame, pieces: list[str], langs: list[str], probabilities: np.ndarray
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``documents`` (doc_id, text)."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(pieces)
        table = segmenter.table(probabilities)
        number: dict[str, int] = {}
        logs = np.empty((1024, len(langs)))
        for part in parts:
            texts = [words_of(t.as_py()) for t in part.column(2)]
            if len(number) > REMEMBERED:
                number = {}
            fresh = [w for w in dict.fromkeys(w for ws in texts for w in ws) if w not in number and len(w) <= LONG_WORD]
            if fresh and langs:
                at = len(number)
                number.update((w, i) for i, w in enumerate(fresh, at))
                if len(number) > len(logs):
                    logs = np.concatenate([logs[:at], np.empty((max(len(number), 2 * at) - at, len(langs)))])
                logs[at : len(number)] = segmenter.log_probabilities(fresh, table)
            best, scores = [], []
            for words in texts:
                if not words or not langs:
                    best.append("und")
                    scores.append(0.0)
                    continue
                total = logs[[number[w] for w in words if len(w) <= LONG_WORD]].sum(0)
                for word in words:
                    if len(word) > LONG_WORD:
                        total += segmenter.long_word(word, table)
                share = np.exp(total - total.max())
                best.append(langs[int(total.argmax())])
                scores.append(float(1 / share.sum()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(best, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    held_out = F.coalesce(F.pmod(crc_of(F.col("doc_id")), F.lit(HELD_OUT[0])) == HELD_OUT[1], F.lit(False))
    rows = documents.select("doc_id", held_out.alias("held_out"), "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def languages(documents: DataFrame, vocabulary_path: str | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the posterior of lang_pred) for every row of ``documents``.

    Learns from text and non-NULL lang of rows whose doc_id is not held out. lang_pred is
    ``und`` with score 0 for a text that is NULL or has no letter (Unicode category L), and for every text when
    nothing could be learned. Ties go to the first language by name. A NULL doc_id is not
    held out and teaches nothing; repeated rows are returned as often; further columns are ignored.
    """
    pieces = vocabulary(vocabulary_path)
    langs, probabilities = fit(documents, pieces, sample_rows)
    return identified(documents, pieces, langs, probabilities)

"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary entries that end at each character; dynamic
programming carries the best score and the number of pieces of the best segmentation, never
the pieces.  Ties follow the public unigram tokenizers: a candidate replaces another only if
its score is strictly larger, candidates come in order of their start, so the longest of
equally good last pieces stays; a character that is no entry by itself may be an unknown
piece at the lowest score minus ten, which counts one for each of its UTF-8 bytes where the
vocabulary has byte pieces, and otherwise one for each run of unknown characters.

Texts are cut at spaces first, as those tokenizers do, so words are solved once per worker
and looked up after that (``MEMO_WORDS`` at most).  One pass, no shuffle.

Defined results: null or empty text has no tokens and no characters; every input row gives
one row, repeated rows included; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

SPACE = "▁"
MEMO_WORDS = 250_000
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def rank_vocabulary(model: str = VOCABULARY) -> list[tuple[str, float]]:
    """Pieces of a piece model in order; the score of the r-th ordinary piece is -ln(r + 1), Zipf's law."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    out, rank = [], 0
    for i in range(sp.vocab_size()):
        ordinary = not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))
        rank += ordinary
        out.append((sp.id_to_piece(i), -math.log(rank + 1) if ordinary else 0.0))
    return out


class Counter:
    """Numbers of pieces of single words."""

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        self.trie = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.trie.add_word(piece, (len(piece), score))
        self.trie.make_automaton()
        self.keep = 1 + max(len(p) for p, _ in vocabulary)
        self.unknown = min(s for _, s in vocabulary) - 10.0
        self.bytes = all(f"<0x{b:02X}>" in self.trie for b in range(256))

    def word(self, word: str) -> int:
        """Pieces of the best segmentation; only the last ``keep`` positions are held."""
        keep = self.keep
        best, count, open_run = [0.0] * keep, [0] * keep, [False] * keep
        found = self.trie.iter(word)
        match = next(found, None)
        for end, char in enumerate(word):
            score, pieces, unknown, single = -math.inf, 0, False, False
            while match and match[0] == end:  # longest first, so by start
                length, value = match[1]
                single |= length == 1
                at = (end + 1 - length) % keep
                if best[at] + value > score:
                    score, pieces, unknown = best[at] + value, count[at] + 1, False
                match = next(found, None)
            at = end % keep
            if not single and best[at] + self.unknown > score:
                score, unknown = best[at] + self.unknown, True
                pieces = count[at] + (len(char.encode()) if self.bytes else not open_run[at])
            at = (end + 1) % keep
            best[at], count[at], open_run[at] = score, pieces, unknown
        return count[len(word) % keep]


def words_of(text: str) -> list[str]:
    """The text cut before each space; spaces become word marks and the first word gets one."""
    parts = text.replace(SPACE, " ").split(" ")
    return parts[1:] if len(parts) > 1 and not parts[0] else parts


def _count(vocabulary):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary.value)
        memo = C.Memo(lambda w: counter.word(SPACE + w), MEMO_WORDS)
        for b in batches:
            texts = b.column(1).to_pylist()
            tokens = [sum(map(memo.__getitem__, words_of(t))) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.int64()), pa.array([len(t) for t in texts], pa.int64())], ["doc_id", "n_tokens", "n_chars"])

    return run


def token_counts(spark: SparkSession, docs: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """(doc_id, n_tokens, n_chars) for every row of *docs*; the broadcast is the vocabulary, whose size is fixed."""
    return C.docs_of(docs).mapInArrow(_count(spark.sparkContext.broadcast(vocabulary)), "doc_id long, n_tokens long, n_chars long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, C.table(spark, sf_dir, "documents"), rank_vocabulary())

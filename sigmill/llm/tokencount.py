"""Token counts of a unigram tokenizer without making tokens: count-only Viterbi."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sigmill.llm.common import documents

MARK = "▁"
#: What an unknown character costs beyond the worst piece, as in the public unigram tokenizers.
UNKNOWN_PENALTY = 10.0
#: Word counts that a task remembers: so many words of at most so many characters (about 40 MB).
REMEMBER, LONGEST = 250_000, 48


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a vocabulary file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts the pieces of the best segmentation.

    No ordinary piece has the word mark behind another character, so words are segmented one by one and their
    counts remembered. Within a word an Aho-Corasick automaton gives all pieces by their end; at each end the best
    score and its piece count are kept. Of equal scores the one whose last piece starts first wins, since the
    tokenizers try starts in ascending order and replace only by a greater score.
    An unknown character costs the least score less a penalty and counts as its UTF-8 bytes if all of them are
    pieces; otherwise a run of unknown characters is one piece.
    """

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.pieces = dict(vocabulary)
        self.automaton = ahocorasick.Automaton()
        for piece, value in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), value))
        self.automaton.make_automaton()
        self.unknown = min(v for _, v in vocabulary) - UNKNOWN_PENALTY
        self.longest = max(len(p) for p, _ in vocabulary)
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of one word (with its mark). What is kept reaches back as far as the longest piece does."""
        matches = self.automaton.iter(word)
        match = next(matches, None)
        size = self.longest + 1
        score, count = [0.0] * size, [0] * size
        open_run = [False] * size  # the best path ends in an unknown character that isn't written in bytes
        n = len(word)
        for end in range(1, n + 1):
            found = []
            while match and match[0] == end - 1:
                found.append(match[1])
                match = next(matches, None)
            best = None
            single = False
            if len(found) > 1:
                found.sort(reverse=True)  # the longest piece starts first
            for length, value in found:
                s = score[(end - length) % size] + value
                single |= length == 1
                if best is None or s > best:
                    best, pieces, run = s, count[(end - length) % size] + 1, False
            if not single:
                before = (end - 1) % size
                s = score[before] + self.unknown
                if best is None or s > best:
                    codes = word[end - 1].encode()
                    if all(f"<0x{b:02X}>" in self.pieces for b in codes):
                        best, pieces, run = s, count[before] + len(codes), False
                    else:
                        best, pieces, run = s, count[before] + (not open_run[before]), True
            at = end % size
            score[at], count[at], open_run[at] = best, pieces, run
        return count[n % size]

    def text(self, text: str) -> int:
        """Pieces of a text: a mark stands before it (unless it has one) and for every space."""
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        if words[0] == "" and len(words) > 1:
            words = words[1:]  # the text's own space is its first mark
        known = self.known
        new = {w for w in set(words).difference(known) if len(w) <= LONGEST}
        if len(known) + len(new) > REMEMBER:
            known.clear()
        for w in new:
            known[w] = self.word(MARK + w)
        total = 0
        for w in words:
            n = known.get(w)
            if n is None:  # too long to be remembered, or forgotten just now
                n = self.word(MARK + w)
                if len(w) <= LONGEST:
                    known[w] = n
            total += n
        return total


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(read_vocabulary(path))


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every whole text.

    Null and empty text have 0 tokens; repeated rows are counted each and a null id stays null; a text without a space
    is one word, walked with a memory as long as the longest piece; an empty table gives an empty table. Nothing is
    shuffled.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = np.fromiter((count.text(t or "") for t in texts), np.int64, len(texts))
            sizes = np.fromiter((len((t or "").encode()) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"])
        count.known.clear()
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op9_tokencount(spark, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))

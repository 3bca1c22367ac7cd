"""Operator 3, token counts: a unigram model's best segmentation, worked out over a trie of pre-tokens.

Pre-tokens are the words of a text (cut at ASCII white space), each behind the word mark U+2581. A word's token
count is that of its best segmentation into pieces of a given vocabulary, where a piece of rank r scores
-log(r + 2) (Zipf's law, in whole millionths, so ties are true ties; among them fewer tokens win). A character that no
piece covers counts as its UTF-8 bytes, each at BYTE_SCORE.

Distinct pre-tokens of a batch are inserted into a trie, here walked depth first over the sorted words: a node is a
shared prefix, and its forward score, the best over all pieces that end there, is computed once and serves every word below
it. Counts at terminals are stored, and a text's count is the sum over its words. It is a map over documents:
nothing is shuffled, and a worker's memory is bounded by REMEMBERED terminals.

Defined results: null and empty texts count 0; repeated rows count each; a null id stays null; an empty table
gives no rows; of further columns none is read.
"""

from __future__ import annotations

import math
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import held, slices, texts_of

MARK, BYTE_SCORE = "▁", -15_000_000
REMEMBERED, LONGEST = 600_000, 64
SCHEMA = "doc_id bigint, n_pretokens bigint, n_tokens bigint"


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model in order of rank, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Forward:
    """Forward scores along the current path of the trie; score and count for each prefix of the last word."""

    def __init__(self, pieces: list[str]):
        # scores are whole numbers of millionths; the token count is taken off in units far below, so ties go to fewer tokens
        self.score = {p: -round(math.log(r + 2) * 1e6) * 4096 - 1 for r, p in enumerate(pieces)}
        self.ends = {p[i:] for p in pieces for i in range(len(p))}
        self.word, self.best, self.count = "", [0], [0]

    def tokens(self, word: str) -> int:
        """The count at the end of the word; nodes that it shares with the word before are not computed again."""
        same, most = 0, min(len(word), len(self.word))
        while same < most and word[same] == self.word[same]:
            same += 1
        best, count, score, ends = self.best, self.count, self.score, self.ends
        del best[same + 1 :], count[same + 1 :]
        for end in range(same + 1, len(word) + 1):
            n = len(word[end - 1].encode())
            top, tokens = best[end - 1] + n * (BYTE_SCORE * 4096 - 1), count[end - 1] + n
            start = end - 1
            while start >= 0 and (tail := word[start:end]) in ends:
                one = score.get(tail)
                if one is not None and best[start] + one > top:
                    top, tokens = best[start] + one, count[start] + 1
                start -= 1
            best.append(top)
            count.append(tokens)
        self.word = word
        return count[len(word)]


def count_tokens(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """doc_id, n_pretokens, n_tokens for each row of docs."""
    key = zlib.crc32("\n".join(pieces).encode())
    shipped = docs.sparkSession.sparkContext.broadcast(pieces)  # a vocabulary: its size is a parameter, not the data's

    def run(batches):
        forward, known = held(("tokencount", key), lambda: (Forward(shipped.value), {}))
        for batch in slices(batches, "text", holding=True):
            split = [(t or b"").split() for t in texts_of(batch, "text")]
            new = set().union(*split)
            if len(known) + len(new) > REMEMBERED:
                known.clear()
            new.difference_update(known)
            for word in sorted(new):
                known[word] = forward.tokens(MARK + word.decode())
            counts = [sum(map(known.__getitem__, words)) for words in split]
            for word in new:
                if len(word) > LONGEST:
                    del known[word]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in split], pa.int64()), pa.array(counts, pa.int64())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)

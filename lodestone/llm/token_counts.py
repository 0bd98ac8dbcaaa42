"""Operator 2, token counts: unigram forward scores over a trie of distinct pre-tokens."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A trie over this many nodes is dropped and begun anew.
NODES = 1_500_000
#: Pre-tokens longer than this are scored with a sliding window and not kept.
LONG = 64
SPACE = "▁"


class Unigram:
    """Piece scores of a public vocabulary: the log of a Zipf weight, 1 / (rank + 1), of each piece.

    A character that no piece covers costs its UTF-8 bytes, each at ``byte_score``.
    """

    def __init__(self, pieces: list[str]):
        norm = math.log(sum(1 / (i + 1) for i in range(len(pieces)))) if pieces else 0.0
        self.score = {}
        for i, p in enumerate(pieces):
            self.score.setdefault(p, -math.log(i + 1) - norm)
        self.longest = max(map(len, pieces), default=1)
        self.byte_score = min(self.score.values(), default=0.0) - 10.0

    @classmethod
    def from_file(cls, path: str) -> Unigram:
        """The ordinary pieces of a sentencepiece file, in the order of their ids."""
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = (i for i in range(s.get_piece_size()) if not (s.is_control(i) or s.is_unknown(i) or s.is_byte(i) or s.is_unused(i)))
        return cls([s.id_to_piece(i) for i in kept if s.get_score(i) > -1e8])

    def step(self, text: str, i: int, best: list[tuple[float, int]]) -> tuple[float, int]:
        """Best (score, minus tokens) of text[:i]; best[k] is that of text[:i-1-k]. Of equal scores fewer tokens win."""
        c = text[i - 1]
        n = len(c.encode("utf-8", "surrogatepass"))
        s, k = best[0]
        top = (s + n * self.byte_score, k - n)
        score = self.score
        for length in range(1, min(len(best), self.longest) + 1):
            p = score.get(text[i - length : i])
            if p is not None:
                s, k = best[length - 1]
                if (s + p, k - 1) > top:
                    top = (s + p, k - 1)
        return top

    def count(self, text: str) -> int:
        """Tokens of one pre-token without a trie, holding only the last scores."""
        best = [(0.0, 0)]
        for i in range(1, len(text) + 1):
            best = [self.step(text, i, best), *best[: self.longest - 1]]
        return -best[0][1]


class Trie:
    """Distinct pre-tokens; a node holds the forward score of its prefix, computed once for all that share it."""

    def __init__(self, model: Unigram):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.best: list[tuple[float, int]] = [(0.0, 0)]
        self.terminal: dict[str, int] = {}

    def count(self, token: str) -> int:
        """Stored terminal count of the pre-token, which is inserted if it is new."""
        found = self.terminal.get(token)
        if found is not None:
            return found
        if len(token) > LONG:
            return self.model.count(SPACE + token)
        if len(self.child) > NODES:
            self.clear()
        node, path, text = 0, [self.best[0]], SPACE + token
        for i, c in enumerate(text, 1):
            nxt = self.child[node].get(c)
            if nxt is None:
                nxt = len(self.child)
                self.child[node][c] = nxt
                self.child.append({})
                self.best.append(self.model.step(text, i, path[::-1]))
            node = nxt
            path.append(self.best[node])
        out = self.terminal[token] = -self.best[node][1]
        return out


_LOADED: dict[str, Trie] = {}


def _counter(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        if path not in _LOADED:
            _LOADED[path] = Trie(Unigram.from_file(path))
        trie = _LOADED[path]
        for b in batches:
            pre, tok = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, t in enumerate(b.column(1).to_pylist()):
                found = (t or "").split()
                pre[i] = len(found)
                get, total = trie.terminal.get, 0
                for w in found:
                    n = get(w)
                    total += trie.count(w) if n is None else n
                    if n is None:
                        get = trie.terminal.get
                tok[i] = total
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pre), pa.array(tok)], schema=schema)

    return run


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, n_pretokens, n_tokens)`` of every whole text, with the unigram model of a vocabulary file.

    Pre-tokens are the runs between white space, each led by the vocabulary's mark for a space, and each is
    segmented by itself. Null and empty texts count 0;
    repeated rows answer each for itself; further columns are ignored. One trie per worker, at most NODES
    nodes; no shuffle.
    """
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_counter(vocabulary), "doc_id bigint, n_pretokens bigint, n_tokens bigint")


def vocabulary_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_file())


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLES: dict[str, str] = {}

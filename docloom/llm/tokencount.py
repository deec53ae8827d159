"""Token counts: batch encoding in Arrow functions that return lengths only.

Rows are regrouped into batches of about equal bytes, and texts above ``piece_bytes`` are cut where the
pre-tokeniser is sure to cut too, so a very long text costs no more memory than a short one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import env_single_thread

#: A letter followed by one space and a letter: byte-level pre-tokenisers always cut before that space.
_SAFE = re.compile(r"(?<=[a-zA-Z]) (?=[a-zA-Z])")


def safe_pieces(text: str, piece_bytes: int, special: tuple[str, ...] = ()) -> list[str]:
    """Cut ``text`` into pieces of at most about ``piece_bytes`` whose token counts add up to the whole's.

    A cut is made only between a letter and the space before the next letter, never inside a special string.
    Without any safe place the text stays whole.
    """
    if len(text) <= piece_bytes:
        return [text]
    out, a = [], 0
    while len(text) - a > piece_bytes:
        m = _SAFE.search(text, a + piece_bytes)
        while m and any(s in text[max(0, m.start() - len(s)) : m.start() + len(s)] for s in special):
            m = _SAFE.search(text, m.start() + 1)
        if not m:
            break
        out.append(text[a : m.start()])
        a = m.start()
    return [*out, text[a:]]


def counter(path: str, piece_bytes: int = 1 << 16) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts for a vocabulary file: ``.json`` as the tokenizers library counts,
    ``.model`` as sentencepiece does.  Added special tokens are left out; special strings inside a text are
    treated as the library does by default.
    """
    env_single_thread()
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    special = tuple(t.content for t in tok.get_added_tokens_decoder().values())
    byte_level = "ByteLevel" in repr(tok.pre_tokenizer) and tok.normalizer is None

    def count(texts: list[str]) -> list[int]:
        out, pieces, where = [0] * len(texts), [], []
        for i, t in enumerate(texts):
            for piece in safe_pieces(t, piece_bytes, special) if byte_level else [t]:
                pieces.append(piece)
                where.append(i)
        # the batch call without offsets: only lengths are wanted
        for i, x in zip(where, tok.encode_batch_fast(pieces, add_special_tokens=False) if pieces else []):
            out[i] += len(x)
        return out

    return count


def _balanced(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    a = total = 0
    for i, n in enumerate(sizes):
        if i > a and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 512, batch_bytes: int = 1 << 20) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (n_tokens > limit) for each row.

    Null and empty texts have 0 bytes and 0 tokens.  Rows stay as they are, repeated ones too; columns of ``docs``
    with those three names are replaced.  Very long texts are cut where the count can't change; one without a letter,
    space, letter (a single huge word) is counted whole, so a worker must hold the largest such text.  There is nothing
    to tie.  One narrow pass over the table: no shuffle, no collect.
    """
    new = ("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in docs.columns if c not in (*new, text)]
    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in keep), "n_bytes long, n_tokens long, over_limit boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in batches:
            col = pc.fill_null(b.column(b.num_columns - 1), "")
            sizes = pc.binary_length(col).to_pylist()
            n: list[int] = []
            for i, j in _balanced(sizes, batch_bytes):
                n += count(col.slice(i, j - i).to_pylist())
            yield pa.record_batch([*(b.column(k) for k in range(len(keep))), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [*keep, *new])

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)

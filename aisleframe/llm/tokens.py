"""Token counts of whole texts by the whole-token shortcut.

A byte-level BPE splits a text into pre-tokens and merges inside each of them
alone. Which entries of the vocabulary encode alone as one token is proved
beforehand by encoding each of them; a pre-token that is such an entry counts
as one token without any merging. The library merges the others. A text with a
character that the two regular-expression engines may class differently, or
with a lone surrogate, goes whole to the library.

Nulls: a null text counts as empty (zero bytes, zero tokens). A null id is
carried through, repeated rows get equal results, an empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: The split of byte-level BPE vocabularies of this family (a fixed value).
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Merged pre-tokens that a worker remembers before it starts afresh.
REMEMBERED = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary and their bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(tokenizer) -> list[str]:
    """The vocabulary strings that are one pre-token and encode as one token."""
    import regex

    alphabet = byte_alphabet()
    split = regex.compile(PRETOKEN)
    found = []
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        try:
            text = bytes(alphabet[c] for c in entry).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if split.findall(text) == [text]:
            found.append(text)
    codes = tokenizer.encode_batch(found, add_special_tokens=False)
    return [t for t, e in zip(found, codes, strict=True) if len(e.ids) == 1]


def _as_library(tokenizer, char: str, split) -> bool:
    """Whether the library splits around this character as the pattern does."""
    for probe in (f"a{char}a", f"1{char}1", f"!{char}!", f"a {char}", f"a {char}a", f"a{char} a"):
        parts = [probe[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
        if parts != split.findall(probe):
            return False
    return True


class _Counts(dict):
    """Tokens of a pre-token; one that is not there is merged when asked for."""

    def __init__(self, tokenizer, whole):
        super().__init__(dict.fromkeys(whole, 1))
        self.tokenizer, self.whole, self.most = tokenizer, whole, len(whole) + REMEMBERED

    def __missing__(self, part: str) -> int:
        n = len(self.tokenizer.encode(part, add_special_tokens=False).ids)
        if len(self) >= self.most:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        self[part] = n
        return n


@lru_cache(maxsize=2)
def _counter(path: str):
    """A function from text to its number of tokens; one per worker and file."""
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    split = regex.compile(PRETOKEN)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    # Inside a pre-token no added string may be found, so merging sees plain text.
    counts = _Counts(tokenizer, whole_tokens(tokenizer))
    alike: dict[str, bool] = {chr(c): True for c in range(128)}

    def library(text: str) -> int:
        return len(tokenizer.encode(text, add_special_tokens=False).ids)

    def count(text: str) -> int:
        if not text.isascii():
            for c in set(text):
                known = alike.get(c)
                if known is None:
                    known = alike[c] = _as_library(tokenizer, c, split)
                if not known:
                    return library(text)
        if any(a in text for a in added):
            return library(text)
        return sum(map(counts.__getitem__, split.findall(text)))

    return count


def count_tokens(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every document.

    ``path`` names a byte-level tokenizer file that every executor can open.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(id_col, text).mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )

"""Greedy word-piece counts by a linear longest-match automaton.

A trie of the vocabulary is closed with failure links (Song et al., 2021, "Fast WordPiece Tokenization"). Where no
piece can grow further, the automaton jumps to the state of what is left after the longest pieces are popped; how
many are popped on the way is known beforehand, so a word's count takes one step a byte and builds no piece.

Symbols are bytes; the last byte of a word is another symbol (byte + 256), which is how vocabularies with an
end-of-word mark are matched: their marked pieces end in such a symbol.
"""

from __future__ import annotations

import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._shared import table

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
PATTERN = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
OUT = "{id} {type}, n_bytes long, n_words long, n_tokens long"


def byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write for bytes: Latin-1's printable ones stand for
    themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str = VOCABULARY, end="</w>") -> list[tuple[int, ...]]:
    """Pieces as symbols, from a ``tokenizers`` JSON file whose pieces are bytes with an end-of-word mark."""
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    letters, out = byte_letters(), []
    for name in names:
        last = name.endswith(end) and name != end
        body = name[: -len(end)] if last else name
        if body and all(c in letters for c in body):
            piece = [letters[c] for c in body]
            out.append((*piece[:-1], piece[-1] + 256 * last))
    return out


class Automaton:
    """next: state * 512 + symbol -> state; fail, popped: by state (fail -1: nothing matches)."""

    def __init__(self, pieces):
        self.next: dict[int, int] = {}
        children: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            at = 0
            for s in piece:
                if s not in children[at]:
                    children[at][s] = len(children)
                    children.append({})
                    whole.append(False)
                at = children[at][s]
            whole[at] = True
        self.fail, self.popped = [-1] * len(children), [0] * len(children)
        queue = [0]
        for u in queue:
            for s, v in children[u].items():
                queue.append(v)
                self.next[u * 512 + s] = v
                if whole[v]:
                    self.fail[v], self.popped[v] = 0, 1
                    continue
                z, n = self.fail[u], self.popped[u]
                while z >= 0 and s not in children[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = children[z][s], n

    def count(self, word: bytes) -> int:
        """Pieces of a word by greedy longest match; 1 (unknown) where no piece matches; 0 for an empty word."""
        if not word:
            return 0
        step, fail, popped, state, n = self.next, self.fail, self.popped, 0, 0
        last = len(word) - 1
        for i, s in enumerate(word):
            if i == last:
                s += 256
            while (to := step.get(state * 512 + s)) is None:
                n += popped[state]
                state = fail[state]
                if state < 0:
                    return 1
            state = to
        while state > 0:  # what is left is popped to its end
            n += popped[state]
            state = fail[state]
            if state < 0:
                return 1
        return n


class Counts(dict):
    """Counts by word, for the words met so far; emptied when it holds ``most`` words."""

    def __init__(self, automaton: Automaton, most=1 << 18):
        super().__init__()
        self.automaton, self.most = automaton, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self.automaton.count(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self[word] = n
        return n


def count_tokens(docs: DataFrame, id_col="doc_id", text_col="text", vocabulary=VOCABULARY, pattern=PATTERN, lower=True) -> DataFrame:
    """id, n_bytes, n_words, n_tokens of every row's whole text.

    Words are the matches of ``pattern`` in the (lowered) text. Null and empty texts have zeros. Rows that repeat are
    counted each; an empty table gives no rows; a very long text is counted whole, held by one task. The driver reads the
    vocabulary and ships its pieces, whose number the vocabulary bounds; texts stay where they are: no shuffle.
    """
    pieces = read_vocabulary(vocabulary)
    shipped = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        counts = Counts(Automaton(shipped.value))
        words_of = regex.compile(pattern).finditer
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            n_bytes, n_words, n_tokens = [], [], []
            for text in texts:
                text = text.as_py() or ""
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                found = [counts[m[0]] for m in words_of(text.lower() if lower else text)]
                n_words.append(len(found))
                n_tokens.append(sum(found))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (n_bytes, n_words, n_tokens))], names=[id_col, "n_bytes", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, OUT.format(id=f"`{id_col}`", type=rows.schema[0].dataType.simpleString()))


def query(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))

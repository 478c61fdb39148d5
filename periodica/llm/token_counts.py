"""Token counts: unigram segmentation by dynamic programming shared in a trie.

Pre-tokens are the words of a text with a word-start mark in front. The distinct pre-tokens of a slice of rows go into
a trie; walking it depth first, the best forward score and token count of every prefix are computed once, however many
pre-tokens share the prefix, and stored for the pre-tokens that end there. A document's count is the sum over its words.

The unigram model takes the pieces of a public vocabulary; a piece of rank r has probability proportional to
1 / (r + 10) (Zipf's law over the order of the vocabulary, which runs from frequent to rare). A character outside the
vocabulary costs one token per UTF-8 byte. Equal scores take the longer last piece.

Edge cases: null and empty texts have no tokens; texts are taken whole, and a single very long word costs time linear
in its length; repeated rows are counted one by one; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import DataFrame

from periodica.llm.common import WORD, map_rows, table

MARK = "▁"
_WORD = re.compile(WORD)


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(2)
def model(path: str) -> tuple[dict[str, float], int, float]:
    """Pieces with log-probabilities, the longest piece's length, and the score of an unknown byte."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    total = math.log(sum(1 / (r + 10) for r in range(len(names))))
    scores = {p: -math.log(r + 10) - total for r, p in enumerate(names)}
    return scores, max(map(len, names)), min(scores.values()) - 5.0


def trie_counts(pretokens: list[str], scores: dict[str, float], longest: int, unknown: float) -> dict[str, int]:
    """Tokens of each distinct pre-token: a depth-first walk over the trie that the sorted pre-tokens form."""
    best, tokens = [0.0], [0]  # forward state of every prefix on the path from the root
    path, out = "", {}
    get = scores.get
    for word in sorted(pretokens):
        depth, most = 0, min(len(path), len(word))
        if path and word.startswith(path):
            depth = len(path)
        else:
            while depth < most and path[depth] == word[depth]:
                depth += 1
        del best[depth + 1 :], tokens[depth + 1 :]
        for i in range(depth + 1, len(word) + 1):
            size = len(word[i - 1].encode("utf-8", "surrogatepass"))
            top, count = best[i - 1] + unknown * size, tokens[i - 1] + size
            for j in range(max(0, i - longest), i):
                p = get(word[j:i])
                if p is not None and best[j] + p > top:
                    top, count = best[j] + p, tokens[j] + 1
            best.append(top)
            tokens.append(count)
        path = word
        out[word] = tokens[-1]
    return out


SCHEMA = "doc_id long, n_pretokens long, n_tokens long, max_word_tokens long"


def count(docs: DataFrame, vocabulary: str | None = None, remembered: int = 400_000) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id and text are read).

    ``remembered`` bounds the pre-tokens whose counts a worker keeps from slice to slice; it changes no result.
    """
    path = vocabulary or vocabulary_path()
    kept: dict[str, int] = {}

    def rows(ids, texts):
        words = [_WORD.findall(t) if t else [] for t in texts]
        new = {w for ws in words for w in ws}.difference(kept)
        if len(kept) + len(new) > remembered:
            kept.clear()
            new = {w for ws in words for w in ws}
        kept.update((w[1:], n) for w, n in trie_counts([MARK + w for w in new], *model(path)).items())
        counts = [[kept[w] for w in ws] for ws in words]
        return {
            "doc_id": ids,
            "n_pretokens": [len(c) for c in counts],
            "n_tokens": [sum(c) for c in counts],
            "max_word_tokens": [max(c, default=0) for c in counts],
        }

    return map_rows(docs.select("doc_id", "text"), rows, SCHEMA)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return count(table(spark, sf_dir, "documents"))

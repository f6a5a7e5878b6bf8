"""Token ids of whole texts under a public vocabulary, a batch at a time."""

from __future__ import annotations

import base64
import functools
import re

import numpy as np

END_ID = 0
_SPECIAL = "<|endoftext|>"


@functools.lru_cache(maxsize=4)
def encoder(vocab: str = "byte_bpe_50k"):
    """Encoder of a byte-level vocabulary file, by name (looked up among the public tokenizers) or by path.

    The rank file holds the same vocabulary as the merges file of that name and encodes several times faster; that both
    give the same ids is tested.
    """
    import public_tokenizers
    import tiktoken

    path = vocab if "/" in vocab else public_tokenizers.path(f"{vocab}.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={_SPECIAL: len(ranks)})


#: White space (Unicode) in runs that the pattern's look-ahead would backtrack through; such a run is one piece by itself.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{5000,}")


@functools.lru_cache(maxsize=4)
def _whole(vocab: str):
    """Encoder that takes a text as one piece."""
    import tiktoken

    return tiktoken.Encoding("whole", pat_str=r"(?s).+", mergeable_ranks=encoder(vocab)._mergeable_ranks, special_tokens={})


def _with_long_space(enc, text: str, vocab: str) -> np.ndarray:
    """Ids of a text cut around long runs of white space, as the pattern itself would cut it: of a run that another
    character follows, the last one goes with what follows."""
    parts, pos = [], 0
    for m in _LONG_SPACE.finditer(text):
        end = m.end() - (m.end() < len(text))
        parts += [enc.encode_to_numpy(text[pos : m.start()], disallowed_special=()), np.array(_whole(vocab).encode_ordinary(text[m.start() : end]), "<u4")]
        pos = end
    return np.concatenate([*parts, enc.encode_to_numpy(text[pos:], disallowed_special=())])


def encode(text: str | None, vocab: str = "byte_bpe_50k") -> np.ndarray:
    """uint32 ids of a whole text (null: empty), closed by END_ID."""
    enc = encoder(vocab)
    if not text:
        return np.array([END_ID], "<u4")
    if _LONG_SPACE.search(text):
        special = np.array([enc.encode_single_token(_SPECIAL)], "<u4")
        ids = np.concatenate([x for part in text.split(_SPECIAL) for x in (_with_long_space(enc, part, vocab), special)][:-1])
    else:
        ids = enc.encode_to_numpy(text, allowed_special={_SPECIAL} if _SPECIAL in text else set(), disallowed_special=())
    out = np.empty(len(ids) + 1, "<u4")
    out[:-1] = ids
    out[-1] = END_ID
    return out

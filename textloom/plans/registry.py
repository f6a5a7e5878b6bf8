"""What a user may add: transforms of blocks, token counters by model, scorers of relevance.

Each is a function over DataFrames or Columns under a name; the request transform looks transforms up here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.bodies import exact_tokens
from ..operators.relevance import bm25_within
from ..operators.shaping import tokenizer_family


@dataclass(frozen=True)
class BlockTransform:
    """apply: (blocks (block_id, content), queries (block_id, query) or None) -> (block_id, digest); a null digest, or no row,
    declines. lossy: the digest gets a marker, and its original is kept."""

    name: str
    lossy: bool
    apply: Callable[[DataFrame, DataFrame | None], DataFrame]


_TRANSFORMS: dict[str, BlockTransform] = {}
_COUNTERS: dict[str, Callable[[Column], Column]] = {}
_SCORERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"bm25": bm25_within}


def register_transform(t: BlockTransform) -> None:
    """Add a transform, or put it in the place of the one of its name."""
    _TRANSFORMS[t.name] = t


def transforms() -> list[BlockTransform]:
    return list(_TRANSFORMS.values())


def register_counter(family: str, count: Callable[[Column], Column]) -> None:
    """Count the tokens of a family's models (see shaping.tokenizer_family) with a function of a text column."""
    _COUNTERS[family] = count


def register_vocabulary(family: str, vocab: str) -> None:
    """Count a family's tokens exactly, with a rank file by name or path."""
    register_counter(family, exact_tokens(vocab))


def count_tokens(text: Column, model: Column) -> Column:
    """Tokens of a text under its row's model: the family's own counter where one is registered, else the estimate."""
    family, out = tokenizer_family(model), T.estimated_tokens(text)
    for name, count in _COUNTERS.items():
        out = F.when(family == name, count(text)).otherwise(out)
    return out


def register_scorer(name: str, score: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Add a scorer: (items (group_id, item_id, text), queries (group_id, text)) -> (group_id, item_id, score)."""
    _SCORERS[name] = score


def scorer(name: str = "bm25") -> Callable[[DataFrame, DataFrame], DataFrame]:
    return _SCORERS[name]

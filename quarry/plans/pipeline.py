"""A search as a chain of components, each replaceable."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quarry.operators import search, suggest
from quarry.operators.index import Index
from quarry.plans.query_language import Query, normalised


@dataclass
class Context:
    """What components read and add to; frames are lazy."""

    query: Query
    index: Index
    history: list[str] = field(default_factory=list)
    hits: DataFrame | None = None
    facets: DataFrame | None = None
    totals: DataFrame | None = None
    suggestions: DataFrame | None = None


Component = Callable[[Context], Context]


def normalise_query(c: Context) -> Context:
    """squeezes white space and settles the mode"""
    c.query = normalised(c.query)
    return c


def retrieve(c: Context) -> Context:
    """matches, ranks and counts"""
    c.hits, c.facets, c.totals = search.search(c.index, c.query, history=c.history)
    return c


def suggest_terms(c: Context) -> Context:
    """offers terms of the best hits"""
    ranked = c.hits.select(F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"), "title", F.col("snippet").alias("text"))  # one page of hits
    c.suggestions = suggest.of_hits(ranked)
    return c


DEFAULT: tuple[Component, ...] = (normalise_query, retrieve, suggest_terms)


def run(context: Context, components: Sequence[Component] = DEFAULT) -> Context:
    for component in components:
        context = component(context)
    return context


def describe(components: Sequence[Component] = DEFAULT) -> list[tuple[str, str]]:
    return [(c.__name__, c.__doc__ or "") for c in components]

"""Texts for people: counts with their nouns, and what is wrong with a saved graph (F27)."""

from __future__ import annotations


def plural(n: int, noun: str) -> str:
    return f"{n} {noun}" + "s" * (n != 1)


def stale_message(path: str, unexpected_nodes: int, missing_nodes: int, unexpected_edges: int) -> str:
    """Why a saved graph can't be used with the comparisons of a configuration."""
    counts = ((unexpected_nodes, "unexpected node"), (missing_nodes, "missing node"), (unexpected_edges, "unexpected edge"))
    return f"{path} belongs to other comparisons: {', '.join(plural(n, noun) for n, noun in counts)}"

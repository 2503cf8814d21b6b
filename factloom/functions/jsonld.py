"""JSON-LD scripts as data: scalars by key as they are written, and the entities that automatic facts read."""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

from factloom.functions.urls import host_of, path_of, quiet

#: The type of a script, its longest text for single items and for entities, and caps within it.
SCRIPT_TYPE = "application/ld+json"
LONGEST_ITEM_SCRIPT, LONGEST_GRAPH_SCRIPT, MOST_CHILDREN, MOST_OFFERS, LONGEST_SCALAR = 4000, 30000, 30, 12, 220
ENTITY_KEYS = ("headline", "name", "description", "datePublished")


def roots(script: str) -> list:
    """The script's objects, fractions kept as they are written; none for what is no JSON."""
    try:
        data = json.loads(script, parse_float=Decimal)
    except (ValueError, TypeError, RecursionError):
        return []
    return data if isinstance(data, list) else [data]


def items(found: list) -> list[dict]:
    """Top-level scalars of each object with the object's number."""
    return [{"item_idx": i, "key": k, "raw_value": str(v)} for i, root in enumerate(found) if isinstance(root, dict) for k, v in root.items() if isinstance(v, (str, int, float, Decimal))]


def scalar_text(value: object) -> str | None:
    """Text of a string or exact number of 1 to 220 characters, white space collapsed."""
    if isinstance(value, bool) or not isinstance(value, (str, int, Decimal)):
        return None
    text = " ".join(str(value).split())
    return text if 0 < len(text) <= LONGEST_SCALAR else None


def _offers(node: dict) -> Iterator[dict]:
    own = node.get("offers")
    for i, offer in enumerate((own if isinstance(own, list) else [own])[:MOST_OFFERS]):
        if isinstance(offer, dict):
            yield {"idx": i, "name": scalar_text(offer.get("name")), "price": scalar_text(offer.get("price")), "currency": scalar_text(offer.get("priceCurrency"))}


def entities(found: list) -> list[dict]:
    """Objects of the graph, or the objects themselves, with types, url, facts and offers."""
    out = []
    for r, root in enumerate(found):
        graph = root.get("@graph") if isinstance(root, dict) else None
        for c, node in enumerate((graph if isinstance(graph, list) else [root])[:MOST_CHILDREN]):
            if not isinstance(node, dict):
                continue
            kinds = node.get("@type", [])
            url = node.get("url") or node.get("mainEntityOfPage")
            url = url.get("@id") if isinstance(url, dict) else url
            url = url if isinstance(url, str) else None
            facts = {k: v for k in ENTITY_KEYS if (v := scalar_text(node.get(k)))}
            out.append({
                "root_idx": r, "child_idx": c, "types": sorted({str(k).rsplit("/", 1)[-1].casefold() for k in (kinds if isinstance(kinds, list) else [kinds])}), "url": url, "host": quiet(host_of, url),
                "own_path": path_of(url), "anchor": (facts.get("headline") or facts.get("name") or "").casefold() or None, "facts": list(facts.items()), "offers": list(_offers(node)),
            })
    return out

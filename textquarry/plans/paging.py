"""Cursors, page envelopes and reasons for empty pages: the edge between frames and callers."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row

CURSOR_VERSION = 2
DEFAULT_LIMIT, MOST_ROWS, NUDGE_TOTAL, NUDGE_TIMES = 10, 1000, 200, 20


class CursorError(ValueError):
    """A cursor that cannot be used for this call."""


def archive_identity(path: str) -> str:
    return hashlib.sha256(path.encode()).hexdigest()[:12]


def encode_cursor(tool: str, **state) -> str:
    body = json.dumps({"v": CURSOR_VERSION, "t": tool, "s": state}, separators=(",", ":"), sort_keys=True)
    return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def decode_cursor(cursor: str, tool: str, **expected) -> dict:
    """The state of a cursor; it must be of this tool and agree with every expected value given."""
    try:
        body = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        version, made_for, state = body["v"], body["t"], body["s"]
    except (ValueError, KeyError, TypeError) as e:
        raise CursorError("the cursor is malformed") from e
    if version != CURSOR_VERSION:
        raise CursorError(f"the cursor is of version {version}, not {CURSOR_VERSION}")
    if made_for != tool:
        raise CursorError(f"the cursor belongs to {made_for}, not {tool}")
    for key, value in expected.items():
        if value is not None and key in state and state[key] != value:
            raise CursorError(f"the cursor was made for another {key}")
    return state


@dataclass
class Page:
    """Rows of one page with where they stand and, if there are none, why."""

    results: list[Row]
    total: int | None
    offset: int
    limit: int
    next_cursor: str | None
    done: bool
    meta: dict = field(default_factory=dict)

    @property
    def page_info(self) -> dict:
        return {"offset": self.offset, "limit": self.limit, "returned": len(self.results)}


def reason(
    query: str | None,
    total: int,
    before_filter: int | None = None,
    strong: int | None = None,
    known_namespace: bool = True,
    *,
    indexed: bool = True,
    failed_archives: int = 0,
    out_of_time: bool = False,
    sampled: bool = False,
    cut_links: bool = False,
    is_html: bool = True,
    n_headings: int | None = None,
) -> str | None:
    """Why a page is empty, weak or not the whole answer; the first reason that holds."""
    if query is not None and not query.strip():
        return "bad_query"
    for code, holds in (
        ("no_xapian_index", not indexed), ("bad_namespace", not known_namespace), ("non_html", not is_html), ("no_headings", n_headings == 0),
        ("search_all_budget_exceeded", out_of_time), ("archive_unavailable", failed_archives > 0), ("no_content_type_match", total == 0 and bool(before_filter)), ("0_hits", total == 0),
        ("sample_only", sampled), ("scan_truncated", cut_links), ("low_relevance", strong == 0),
    ):
        if holds:
            return code
    return None


def take_page(ordered: DataFrame, tool: str, limit: int = DEFAULT_LIMIT, offset: int = 0, total: int | None = None, **state) -> Page:
    """One page of an ordered frame; one row more than asked tells whether it goes on."""
    if not 1 <= limit <= MOST_ROWS or offset < 0:
        raise ValueError(f"limit must be 1 to {MOST_ROWS} and offset at least 0")
    rows = ordered.offset(offset).limit(limit + 1).collect()
    more = len(rows) > limit
    rows = rows[:limit]
    cursor = encode_cursor(tool, o=offset + limit, l=limit, **state) if more else None
    meta = {}
    if total is not None and total >= NUDGE_TOTAL and total >= NUDGE_TIMES * limit:
        meta["refine"] = True
    return Page(rows, total, offset, limit, cursor, not more, meta)


def page_length(text: str, limit: int) -> int:
    """Characters on a page of text: white space at its end is left to the next page, so pages join without loss."""
    if len(text) <= limit:
        return len(text)
    kept = len(text[:limit].rstrip())
    return kept or limit

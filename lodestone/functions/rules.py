"""Semantic tags of symbols from a file's text: each pattern is matched once a file, its hits are given to spans."""

from __future__ import annotations

import re
from bisect import bisect_right

from .intervals import Hits, innermost

#: The patterns of the rules (fixed values).
DB_READ = r"""(?i)(?:pool|client|db|connection)\.query\s*\(\s*['"`]SELECT|\bprisma\.\w+\.(?:findMany|findFirst|findUnique|findOne|count|aggregate|groupBy)\s*\(|\bdb\.(?:select|from)\s*\(|\b(?:knex|db)\s*\(\s*['"`]\w|\bknex\s*\.\s*select\s*\(|\.select\s*\("""
DB_WRITE = r"""(?i)(?:pool|client|db|connection)\.query\s*\(\s*['"`](?:INSERT|UPDATE|DELETE)|\bprisma\.\w+\.(?:create|createMany|update|updateMany|upsert|delete|deleteMany)\s*\(|\.insert\s*\(|\.update\s*\(|\.delete\s*\(|\.upsert\s*\("""
DB_CALL = r"""(?:pool|client|db|connection)\.query\s*\(|\bprisma\.\w+\.\w+\s*\(|\b(?:knex|db)\s*\(\s*['"`]\w|\bknex\s*\.\s*(?:select|insert|update|delete|from|where)\s*\(|\.(?:select|insert|update|delete|where)\s*\("""
TENANT = "tenant_id"
TRY = r"\btry\s*\{"
FETCH = r"await\s+fetch"
ROUTE = r"(?:router|app)\.(get|post|put|delete|patch)\s*\(|@(Get|Post|Put|Delete|Patch)\s*\("
AUTH = r"@(?:Auth|Guard|UseGuards)\s*\(|authenticate\s*[,(]|requireAuth\s*[,(]"
VALIDATED = r"@(?:Body|Param|Query)\s*\(|validate\s*\(|schema\.parse\s*\(|\.safeParse\s*\("

#: Of each pattern, strings of which a text with a match holds one, in lower case.
_NEEDED = {
    DB_READ: ["query", "prisma", "db", "knex", ".select"],
    DB_WRITE: ["query", "prisma", ".insert", ".update", ".delete", ".upsert"],
    DB_CALL: ["query", "prisma", "db", "knex", ".select", ".insert", ".update", ".delete", ".where"],
    TRY: ["try"],
    FETCH: ["fetch"],
    ROUTE: ["router.", "app.", "@get", "@post", "@put", "@delete", "@patch"],
    AUTH: ["@auth", "@guard", "@useguards", "authenticate", "requireauth"],
    VALIDATED: ["@body", "@param", "@query", "validate", "schema.parse", ".safeparse"],
}


def _compiled(pattern: str, overlapping: bool) -> re.Pattern:
    """ASCII classes, as the rules' users know them; flags at a pattern's start hold for all of it."""
    flags, m = re.A, re.match(r"\(\?([imsx]+)\)", pattern)
    if m:
        pattern = pattern[m.end() :]
        for ch in m[1]:
            flags |= {"i": re.I, "m": re.M, "s": re.S, "x": re.X}[ch]
    return re.compile(f"(?=({pattern}))" if overlapping else pattern, flags)


_FIXED = {p: _compiled(p, False) for p in _NEEDED}


class Tagger:
    """The rules, and further ones: (pattern, tag)."""

    def __init__(self, custom: list[tuple[str, str]] = ()):
        self.custom = [(_compiled(p, True), t) for p, t in custom]

    def tags(self, text: str, symbols: list[tuple[int, str, int, int, int]]) -> list[tuple[int, str, str]]:
        """(ordinal, name, tag) of a file's symbols (ordinal, name, first line, last line, async), in the order of ordinals.

        Tags belong to names: the last symbol of a name gives them, its first row gets them, and routes found by line are
        added to the name of the innermost symbol.
        """
        lower = text.lower()
        begin = [0] + [m.end() for m in re.finditer("\n", text)]
        found = {p: [m.span() for m in r.finditer(text)] if any(n in lower for n in _NEEDED[p]) else [] for p, r in _FIXED.items()}
        hits = {p: Hits(s) for p, s in found.items()}
        tenant = Hits([m.span() for m in re.finditer(TENANT, text)])
        custom = [(Hits([m.span(1) for m in r.finditer(text)]), t) for r, t in self.custom]
        last: dict[str, tuple[int, int, int, int]] = {}
        first: dict[str, int] = {}
        for ordinal, name, start, end, is_async in symbols:
            first[name] = min(first.get(name, ordinal), ordinal)
            if name not in last or ordinal > last[name][0]:
                last[name] = (ordinal, start, end, is_async)
        routes = self._routes(found[ROUTE], begin, symbols)
        out = []
        for name in sorted(first, key=first.__getitem__):
            _, start, end, is_async = last[name]
            a = begin[min(max(start, 1), len(begin)) - 1]
            b = begin[end] - 1 if end < len(begin) else len(text)
            own = self._own(lambda p: hits[p].within(a, b), tenant.within(a, b), is_async)  # noqa: B023
            own += [t for h, t in custom if h.within(a, b)]
            if name in routes and "route_handler" not in own:
                own.append("route_handler")
            out += [(first[name], name, t) for t in own]
        return out

    @staticmethod
    def _own(holds, tenant: bool, is_async: int) -> list[str]:
        call = holds(DB_CALL)
        out = ["async"] if is_async == 1 else []
        out += [t for p, t in ((DB_READ, "db_read"), (DB_WRITE, "db_write")) if holds(p)]
        if call:
            out.append("tenant_scoped" if tenant else "unscoped_query")
        if holds(TRY):
            out.append("error_handler")
        elif call or holds(FETCH):
            out.append("no_error_handling")
        return out + [t for p, t in ((AUTH, "auth"), (VALIDATED, "validated"), (ROUTE, "route_handler")) if holds(p)]

    @staticmethod
    def _routes(spans: list[tuple[int, int]], begin: list[int], symbols: list[tuple[int, str, int, int, int]]) -> set[str]:
        return {symbols[i][1] for _, i in route_lines(spans, begin, symbols) if i >= 0}


def route_lines(spans: list[tuple[int, int]], begin: list[int], symbols: list[tuple[int, str, int, int, int]]) -> list[tuple[int, int]]:
    """(line, place of the innermost symbol or -1) of the lines that hold a match whole."""
    lines = sorted({bisect_right(begin, a) for a, b in spans if bisect_right(begin, a) == bisect_right(begin, b - 1)})
    at = innermost([s[2] for s in symbols], [s[3] for s in symbols], [s[0] for s in symbols], lines)
    return list(zip(lines, at, strict=True))


def route_lines_of(text: str, symbols: list[tuple[int, str, int, int, int]]) -> list[tuple[int, int]]:
    begin = [0] + [m.end() for m in re.finditer("\n", text)]
    return route_lines([m.span() for m in _FIXED[ROUTE].finditer(text)], begin, symbols)

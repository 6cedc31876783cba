"""The queries as text tools: arguments checked and clamped, results as lines."""

from __future__ import annotations

from loomgraph.functions.text import is_file_target, resolve_budget, resolve_depth, resolve_top_k
from loomgraph.plans.index import CodeIndex, MissingIndex
from loomgraph.sources.snapshots import CorruptIndex


def _guarded(index: CodeIndex, run) -> str:
    try:
        if not index.store.exists():
            return f"No index. Run reindex on {index.root} first."
        return run()
    except (CorruptIndex, MissingIndex) as e:
        return str(e)


def _row(*parts) -> str:
    return "  ".join(str(p) for p in parts if p is not None)


def code_find(index: CodeIndex, query: str, top_k=None, kind: str | None = None) -> str:
    def run() -> str:
        rows = index.find(query, kind, resolve_top_k(top_k)).collect() if query else []
        return "\n".join(_row(f"{r['file']}:{r['line']}", r["kind"], r["name"], r["signature"]) for r in rows) or f'No symbol "{query}". Try a text search.'

    return _guarded(index, run)


def code_trace(index: CodeIndex, symbol: str, direction: str = "callers", depth=None) -> str:
    def run() -> str:
        trace = index.callees if direction == "callees" else index.callers
        rows = trace(symbol, resolve_depth(depth)).collect()
        return "\n".join(_row(r["depth"], r["via"], r["file"], r["symbol"]) for r in rows) or f'No calls found for "{symbol}". Check the name with code_find.'

    return _guarded(index, run)


def code_impact(index: CodeIndex, target: str, depth=None) -> str:
    def run() -> str:
        kind = {"file": target} if is_file_target(target) else {"symbol": target}
        rows = index.impact(**kind, depth=resolve_depth(depth)).collect()
        by = {s: [r["value"] for r in rows if r["section"] == s] for s in ("files", "symbols", "tests")}
        files = [f for f in by["files"] if f not in set(by["tests"])]
        lines = [f"Affected: files {len(files)} | symbols {len(by['symbols'])} | tests {len(by['tests'])}", *files]
        return "\n".join(lines + (["Tests:", *[f"test:{t}" for t in by["tests"]]] if by["tests"] else []))

    return _guarded(index, run)


def code_map(index: CodeIndex, token_budget=None) -> str:
    def run() -> str:
        budget = resolve_budget(token_budget)
        if index.table("symbols").isEmpty():
            return "The index has no symbols."
        rows = index.map(budget).collect()
        shown = sum(1 - r["is_symbol"] for r in rows)
        head = f"Map: {shown} files / {len(rows) - shown} symbols / {sum(r['cost'] for r in rows)} tokens (budget {budget})"
        return "\n".join([head, *[r["text"] for r in rows], *(["... cut at the budget"] if not rows or rows[-1]["truncated"] else [])])

    return _guarded(index, run)


def reindex(index: CodeIndex) -> str:
    try:
        r = index.reindex()
        return f"Indexed: {r.files} files parsed, {r.symbols} symbols, {r.ms} ms"
    except CorruptIndex as e:
        return str(e)


def code_doctor(index: CodeIndex, try_load=None) -> str:
    return "\n".join(f"{r['check']}: {r['status']}" + (f" {r['detail']}" if r["detail"] else "") for r in index.doctor(try_load).collect())

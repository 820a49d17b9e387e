"""Reports: the collected rows of a command as parts by level of detail, and as JSON.

In each report the levels are f(ull), s(ummary) and c(ounts).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import groupby

from strata.functions.address import line_span
from strata.functions.budget import LADDER, Part, commas, estimate_tokens, pad, plural, shown, widest, within
from strata.operators.graph import TIERS

#: Names that are offered for a miss; documents of a summary.
LISTED = 50
FIRST = 20


@dataclass
class Report:
    text: str
    json: dict
    found: bool


def report(command: str, budget: int, parts: list[Part], found: bool, **payload) -> Report:
    text, level = within(budget, parts)
    head = {"command": command, "found": found, "detail": level, "degraded": level != LADDER[0], "budget": budget,
            "tokens": estimate_tokens(text)}
    return Report(text, head | payload, found)


def last(quiet: bool, at: str, line: str) -> Part:
    return Part("" if quiet else at, [line])


def listing(*lines: str) -> str:
    return "".join(line + "\n" for line in lines)


def pick(rows: list[dict], *names: str) -> list[dict]:
    return [{n: row[n] for n in names} for row in rows]


def by_path(rows: list[dict]):
    return [(path, list(group)) for path, group in groupby(rows, key=lambda r: r["path"])]


def span(row: dict) -> str:
    return line_span(row["start_line"], row["end_line"])


def slice_report(address: str, rows: list[dict], budget: int, quiet: bool, signature_only: bool) -> Report:
    total = sum(r["lines"] for r in rows)
    sized = [f"{r['address']}  {span(r)}  {plural(r['lines'], 'line')}" for r in rows]
    parts = [Part("c", [f"{commas(len(rows))} matching {'definition' if len(rows) == 1 else 'definitions'} at {address}, {plural(total, 'line')}",
                        *(f"  {line}" for line in sized), "raise --budget to see the bodies"])]
    for number, (r, line) in enumerate(zip(rows, sized, strict=True), 1):
        title = line + (f"  ({number} of {len(rows)})" if len(rows) > 1 else "")
        parts += [Part("fs" if signature_only else "f", [title, *r["text"].split("\n")]),
                  Part("" if signature_only else "s", [title, *r["signature"].split("\n")])]
    parts += [Part("" if signature_only else "s", ["budget reached: signatures only, raise --budget for bodies"]),
              last(quiet, "fsc", f"{plural(len(rows), 'match', 'matches')}, {plural(total, 'line')}")]
    return report("slice", budget, parts, True, address=address, summary={"matches": len(rows), "lines": total},
                  matches=pick(rows, "address", "path", "kind", "name", "start_line", "end_line", "lines", "signature", "text"))


def slice_miss(address: str, dotted: str, path: str, names: list[tuple[str, int]]) -> Report:
    known = ["this file defines no symbols"]
    if names:
        known = ["available:", *(f"  {path}#{name}" + (f"  ({n} definitions)" if n > 1 else "") for name, n in names[:LISTED]),
                 *shown(min(LISTED, len(names)), len(names), "run `map` on this file for the whole outline")]
    return Report(listing(f"no symbol `{dotted}` in {path}", *known), {
        "command": "slice", "address": address, "found": False, "matches": [],
        "available": [{"address": f"{path}#{name}", "definitions": n} for name, n in names]}, False)


def index_miss(command: str, address: str, path: str, dotted: str, names: list[str]) -> Report:
    known = ["available:", *(f"  {path}#{name}" for name in names[:LISTED])] if names else ["this file is not indexed: is the path right?"]
    extra = {"callers": []} if command == "callers" else {}
    return Report(listing(f"no symbol `{dotted}` in {path}", *known),
                  {"command": command, "address": address, "found": False, "available": names} | extra, False)


def wrong_selector(command: str, address: str) -> Report:
    message = f"{command} needs a symbol address, not an outline or a line span"
    return Report(message + "\n", {"command": command, "address": address, "found": False, "error": message}, False)


def outline_report(path: str, lines: int, rows: list[dict], budget: int, quiet: bool) -> Report:
    labels = ["  " * r["depth"] + r["signature"] for r in rows]
    places = [f"  {span(r)}" + (f"  +{r['hidden_children']} nested" if r["hidden_children"] else "") for r in rows]
    width = widest(labels, 72) + 2
    kinds = sorted(Counter(r["kind"] for r in rows).items())
    parts = [Part("fsc", [f"{path}  {plural(lines, 'line')}  {plural(len(rows), 'symbol')}"])]
    if rows:
        parts += [
            Part("c", [*(f"  {plural(n, kind)}" for kind, n in kinds), "raise --budget or use --depth 1 for the outline"], near=True),
            Part("s", [*((pad(label, 3) + place).rstrip() for label, place, r in zip(labels, places, rows, strict=True) if r["depth"] == 1),
                       "budget reached: top-level symbols only, raise --budget for the rest"], near=True),
            Part("f", [(pad(label, width) + place).rstrip() for label, place in zip(labels, places, strict=True)], near=True),
            last(quiet, "fsc", f"slice {path}#<Symbol> for a body")]
    else:
        parts.append(Part("fsc", ["  no definitions"], near=True))
    return report("map", budget, parts, bool(rows), target=path, kind="file", language="python",
                  summary={"lines": lines, "symbols": len(rows)},
                  symbols=pick(rows, "address", "name", "kind", "signature", "start_line", "end_line", "lines", "depth", "hidden_children"))


def tree_report(target: str, files: int, lines: int, languages: list[dict], tree: list[dict], depth: int,
                points: list[dict], manifests: list[str], budget: int, quiet: bool) -> Report:
    sizes = lambda r: f"{plural(r['files'], 'file')}  {plural(r['lines'], 'line')}"
    folders = []
    for r in sorted((r for r in tree if r["prefix"]), key=lambda r: r["prefix"].split("/")):
        *above, name = r["prefix"].split("/")
        folders.append("  " * (len(above) + 1) + f"{name}/  {sizes(r)}")
    width = widest((p["address"] for p in points), 64)
    parts = [Part("fsc", [f"{target}  {plural(files, 'source file')}  {plural(lines, 'line')}"])]
    if files:
        parts += [
            Part("c", [f"  {plural(len(points), 'entry point')}  {plural(len(manifests), 'manifest')}",
                       "raise --budget for the tree and entry points"], near=True),
            Part("fs", ["languages", *(f"  {pad(r['lang'], 8)}  {sizes(r)}" for r in languages)]),
            Part("f", [f"tree (depth {depth})", *(folders or ["  (flat)"])]),
            Part("fs", ["entry points", *([f"  {pad(p['address'], width)}  {p['reason']}" for p in points] or ["  none detected"])]),
            Part("f" if manifests else "", ["manifests", *(f"  {m}" for m in manifests)]),
            Part("s", ["budget reached: tree and manifests omitted, raise --budget"]),
            last(quiet, "fs", f"map {target}/<file> for a file outline")]
    else:
        parts.append(Part("fsc", ["  no supported source files"], near=True))
    return report("map", budget, parts, files > 0, target=target, kind="directory",
                  summary={"files": files, "lines": lines, "entry_points": len(points)},
                  languages=[{"language": r["lang"], "files": r["files"], "lines": r["lines"]} for r in languages],
                  entry_points=pick(points, "address", "reason"), manifests=manifests)


def find_report(pattern: str, rows: list[dict], over: bool, budget: int, quiet: bool, symbols: bool, bare: bool) -> Report:
    groups = by_path(rows)
    total = f"{plural(len(rows), 'match', 'matches')} in {plural(len(groups), 'file')}"
    width, hits, counts, inside = widest((r["text"] for r in rows), 48), [], [], []
    for path, group in groups:
        count = f"{path}  {plural(len(group), 'match', 'matches')}"
        names = sorted({r["enclosing"] for r in group if r["enclosing"] is not None})
        counts.append(f"  {count}")
        inside += [count, *([f"  in {', '.join(names)}"] if names else [])]
        block = [path]
        for r in group:
            where = "at module level" if r["enclosing"] is None else f"in #{r['enclosing']}"
            text = f"{pad(r['text'], width)}  {where}" if symbols else r["text"]
            line = f"  {pad('L%d' % r['line'], 6)}  {pad(r['occurrence'], 12)}{text}"
            block.append(line if symbols else line.rstrip())
        hits.append(Part("f", block))
    if rows:
        parts = [Part("c", [f"`{pattern}`: {total}", *counts, "raise --budget for the locations"]),
                 Part("s", [*inside, "budget reached: per-file counts only, raise --budget for lines"]), *hits,
                 Part("fsc" if over else "", shown(len(rows), len(rows) + 1, "narrow the pattern or paths"), near=True),
                 last(quiet, "fsc", total)]
    else:
        hint = ["comments and string bodies are excluded: add --include-comments or --include-strings"] if bare else []
        parts = [Part("fsc", [f"no match for `{pattern}`", *hint])]
    hits = pick(rows, "path", "line", "occurrence", "text", "enclosing", "address")
    return report("find", budget, parts, bool(rows), pattern=pattern, truncated=over,
                  summary={"matches": len(rows), "files": len(groups)},
                  files=[{"path": path, "hits": group} for path, group in by_path(hits)])


#: Escapes that a quoted value is shown with.
_ESCAPES = {"\t": "\\t", "\r": "\\r", "\n": "\\n", "'": "'", '"': '\\"', "\\": "\\\\", "\0": "\\0"}


def displayed(value: str, kind: str) -> str:
    line = value.replace("\n", "\\n")
    line = line if len(line) <= 56 else line[:53] + "..."
    if kind == "number":
        return line
    return '"' + "".join(_ESCAPES.get(c) or (c if c.isprintable() else f"\\u{{{ord(c):x}}}") for c in line) + '"'


def literals_report(rows: list[dict], over: bool, budget: int, quiet: bool, group: bool, skeleton: bool, docstrings: bool) -> Report:
    together: dict[tuple, list[dict]] = {}
    for r in rows:
        together.setdefault((r["kind"], r["value"]), []).append({"address": r["address"], "line": r["line"]})
    groups = [{"value": v, "kind": k, "count": len(s), "sites": s} for (k, v), s in together.items()]
    groups.sort(key=lambda g: (-g["count"], g["kind"], g["value"]))
    total = f"{plural(len(rows), 'literal')}, {len(groups)} distinct"
    parts = [Part("c", [total, *(f"  {plural(n, kind)}" for kind, n in sorted(Counter(r["kind"] for r in rows).items())),
                        "raise --budget for the values"])]
    if group:
        width = widest((displayed(g["value"], g["kind"]) for g in groups), 56)
        for g in groups:
            at = widest((s["address"] for s in g["sites"]), 64)
            parts += [Part("fs", [f"{pad(displayed(g['value'], g['kind']), width)}  {pad(g['kind'], 6)}  x{g['count']}"], near=True),
                      Part("f", [f"  {pad(s['address'], at)}  L{s['line']}" for s in g["sites"]], near=True)]
    else:
        parts += [Part("fs", [path, *(f"  {pad('L%d' % r['line'], 6)}  {pad(r['kind'], 6)}  {displayed(r['value'], r['kind'])}" for r in some)])
                  for path, some in by_path(rows)]
    parts += [Part("s", ["budget reached: values without call sites, raise --budget"], near=True),
              Part("fs" if over else "", [f"showing the first {len(rows)} literals — narrow with --in or --match"], near=True),
              last(quiet, "fs", total)]
    if not rows:
        parts = [Part("fsc", ["no literals matched", *([] if docstrings else ["docstrings are excluded: add --include-docstrings"])])]
    return report("literals", budget, parts, bool(rows), truncated=over, grouped=group, skeleton=skeleton,
                  summary={"literals": len(rows), "distinct": len(groups)}, groups=groups if group else None,
                  literals=None if group else pick(rows, "path", "line", "kind", "value", "enclosing", "address"))


def callers_report(address: str, signature: str, definitions: int, homonyms: int, rows: list[dict], budget: int, quiet: bool) -> Report:
    tests = sum(r["is_test"] for r in rows)
    tiers = {t: [r for r in rows if r["confidence"] == t] for t in TIERS}
    width = widest((r["address"] for r in rows), 56)
    parts = [Part("fsc", [f"{address}  {signature}"]),
             Part("c", [f"  {plural(len(rows), 'caller')}: " + ", ".join(f"{len(some)} {t}" for t, some in tiers.items()),
                        "raise --budget for the call sites"], near=True)]
    for tier, some in tiers.items():
        short, long = [f"{tier}  {len(some)}"], [tier]
        for r in some:
            tag = " [test]" if r["is_test"] else ""
            short.append(f"  {r['address']}{tag}")
            long.append(f"  {pad(r['address'], width)}  {pad('L%d' % r['line'], 6)}  {pad('%d args%s' % (r['arity'], tag), 14)}  {r['reason']}")
        parts += [Part("s" if some else "", short), Part("f" if some else "", long)]
    parts += [Part("s", ["budget reached: addresses only, raise --budget for reasons"], near=True),
              last(quiet, "fsc", f"{plural(len(rows), 'caller')} ({len(rows) - tests} non-test, {tests} test)")]
    if not rows:
        parts[1:] = [Part("fsc", ["  no call sites found", "  reflection, DI and dynamic dispatch are invisible here"], near=True)]
    return report("callers", budget, parts, bool(rows), address=address,
                  target={"signature": signature, "definitions": definitions, "homonyms": homonyms},
                  summary={"callers": len(rows), "tests": tests} | {t: len(some) for t, some in tiers.items()},
                  callers=pick(rows, "address", "path", "line", "call", "arity", "confidence", "is_test", "reason"))


def packet_report(address: str, target: dict, callers: list[dict], callees: list[dict], types: list[dict], budget: int, quiet: bool) -> Report:
    total = f"{plural(len(callers), 'caller')}, {plural(len(callees), 'callee')}, {plural(len(types), 'type')}"
    parts = [Part("fsc", [f"packet {address}"]),
             Part("c", [f"  {target['signature']}", f"  {total}", "raise --budget for the body"], near=True),
             Part("fs", [f"target  L{target['start_line']}-L{target['end_line']}", *target["body"].split("\n")]),
             Part("s", [f"{total} — raise --budget for their signatures"])]
    sides = {"callers": callers, "callees": callees, "types": types}
    for title, rows in zip(("callers", "callees", "types in the signature"), sides.values(), strict=True):
        width = widest((r["address"] for r in rows), 56)
        parts.append(Part("f", [f"{title}  {len(rows) or 'none'}", *(
            f"  {pad(r['address'], width)}  {r['signature']}  ({r['note']})" for r in rows)]))
    out = report("packet", budget, [*parts, last(quiet, "f", total)], True, address=address, target=target)
    out.json |= {name: pick(rows, "address", "signature", "note") for name, rows in sides.items()}
    return out


def dead_report(rows: list[dict], files: int, budget: int, quiet: bool) -> Report:
    total, width = sum(r["lines"] for r in rows), widest((r["address"] for r in rows), 56)
    parts = [Part("fsc", ["dead-code candidates: zero call sites, not exported, not entry points, not tests"])]
    if rows:
        parts += [Part("c", [f"  {plural(len(rows), 'candidate')}, {plural(total, 'line')}", "raise --budget for the addresses"], near=True),
                  Part("s", [*(f"  {r['address']}" for r in rows), "budget reached: addresses only, raise --budget for signatures"], near=True)]
        for path, some in by_path(rows):
            parts.append(Part("f", [path, *(
                f"  {pad(r['address'], width)}  {pad('L%d-L%d' % (r['start_line'], r['end_line']), 12)}  {r['signature']}" for r in some)]))
        parts.append(last(quiet, "fsc", f"{plural(len(rows), 'candidate')} — reflection and DI defeat this, verify before deleting"))
    else:
        parts.append(Part("fsc", ["  none found"], near=True))
    return report("dead", budget, parts, bool(rows), summary={"candidates": len(rows), "lines": total, "files_scanned": files},
                  candidates=pick(rows, "address", "path", "kind", "signature", "start_line", "end_line", "lines"))


# ---- documents --------------------------------------------------------------

def doc_slice_report(address: str, kind: str, rows: list[dict], budget: int, quiet: bool) -> Report:
    parts = [Part("c", [*(f"{r['address']}  {span(r)}  {r['kind']}  {r['summary']}" for r in rows), "raise --budget to see the value"])]
    for number, r in enumerate(rows, 1):
        title = f"{r['address']}  {span(r)}  {plural(r['lines'], 'line')}  {r['kind']}" + (f"  ({number} of {len(rows)})" if len(rows) > 1 else "")
        parts += [Part(level, [title, *r[name].split("\n")]) for level, name in (("f", "text"), ("s", "summary"))]
    parts += [Part("s", ["budget reached: summaries only, raise --budget for values"]),
              last(quiet, "fsc", plural(len(rows), "match", "matches"))]
    return report("slice", budget, parts, True, address=address, format=kind, summary={"matches": len(rows)},
                  matches=pick(rows, "address", "path", "kind", "start_line", "end_line", "lines", "summary", "text"))


def doc_miss(address: str, selector: str, path: str, names: list[str]) -> Report:
    known = ["this document is empty"]
    if names:
        known = ["available:", *(f"  {path}#{name}" for name in names[:LISTED]),
                 *shown(min(LISTED, len(names)), len(names), "run `map` on this file for the whole outline")]
    return Report(listing(f"no entry `{selector}` in {path}", *known),
                  {"command": "slice", "address": address, "found": False, "matches": [], "available": names}, False)


def doc_outline_report(path: str, kind: str, rows: list[dict], budget: int, quiet: bool) -> Report:
    def lines(some: list[dict]) -> list[str]:
        labels = ["  " * r["depth"] + r["key"] for r in some]
        width = widest(labels, 48) + 2
        return [f"{pad(label, width)}  {pad(span(r), 12)}  {r['summary']}" + (f"  +{r['hidden_children']} nested" if r["hidden_children"] else "")
                for label, r in zip(labels, some, strict=True)]

    top = [r for r in rows if r["depth"] == 1]
    parts = [Part("fsc", [f"{path}  {kind}  {plural(len(rows), 'entry', 'entries')}"])]
    if rows:
        parts += [Part("c", [f"  {len(top)} top-level {'sections' if kind == 'markdown' else 'keys'}", "raise --budget for the outline"], near=True),
                  Part("f", [line.rstrip() for line in lines(rows)], near=True),
                  Part("s", [*(line.rstrip() for line in lines(top)), "budget reached: top level only, raise --budget"], near=True),
                  last(quiet, "fsc", f"slice {rows[0]['address']} for the value")]
    else:
        parts.append(Part("fsc", ["  empty document"], near=True))
    return report("map", budget, parts, bool(rows), target=path, format=kind, summary={"entries": len(rows)},
                  entries=pick(rows, "address", "key", "kind", "summary", "start_line", "end_line", "depth", "hidden_children"))


def doc_tree_report(target: str, rows: list[dict], budget: int, quiet: bool) -> Report:
    width = widest((r["path"] for r in rows), 56)
    lines = [f"  {pad(r['path'], width)}  {pad(r['format'], 9)}  {pad(plural(r['entries'], 'entry', 'entries'), 12)}  {plural(r['lines'], 'line')}"
             for r in rows]
    parts = [Part("fsc", [f"{target}  {plural(len(rows), 'document')}"])]
    if rows:
        parts += [Part("c", ["raise --budget for the file list"], near=True), Part("f", lines, near=True),
                  Part("s", [*lines[:FIRST], *shown(min(FIRST, len(rows)), len(rows), "raise --budget")], near=True),
                  last(quiet, "fs", f"map {target}/<file> for a document outline")]
    else:
        parts.append(Part("fsc", ["  no json, yaml or markdown files"], near=True))
    return report("map", budget, parts, bool(rows), target=target, kind="directory", documents=pick(rows, "path", "format", "entries", "lines"))


def doc_find_report(pattern: str, rows: list[dict], budget: int, quiet: bool) -> Report:
    total, width = plural(len(rows), "match", "matches"), widest((r["address"] for r in rows), 56)
    parts = [Part("c", [f"`{pattern}`: {total}", "raise --budget for the addresses"])]
    for path, some in by_path(rows):
        parts += [Part("s", [path, *(f"  {r['address']}" for r in some)]),
                  Part("f", [path, *(f"  {pad(r['address'], width)}  {pad('L%d' % r['line'], 6)}  {pad(r['where_'], 5)}  {r['text']}" for r in some)])]
    parts.append(last(quiet, "fs", total))
    if not rows:
        parts = [Part("fsc", [f"no match for `{pattern}`"])]
    return report("find", budget, parts, bool(rows), pattern=pattern, summary={"matches": len(rows)},
                  matches=pick(rows, "address", "path", "line", "where_", "text"))

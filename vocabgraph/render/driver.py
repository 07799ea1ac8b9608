"""Text, HTML and Mermaid of single results that were collected within a bound. The wording and signs of the output."""

from __future__ import annotations

from html import escape
from itertools import groupby
from typing import Literal

from ..model import ConceptView, GraphPath, GraphTrace, PathExplanation, Subgraph

Format = Literal["auto", "html", "text", "mmd"]
TEXT_TARGETS, HTML_TARGETS, CARDS = 6, 5, 20


def _resolve(fmt: Format) -> str:
    if fmt != "auto":
        return fmt
    try:
        from IPython import get_ipython

        shell = get_ipython()
        return "html" if shell is not None and "IPKernelApp" in shell.config else "text"
    except ImportError:
        return "text"


def _names(kg, ids) -> dict[int, ConceptView]:
    return {c.concept_id: c for c in kg.concept_views(sorted(set(ids)))}


def _name(known: dict[int, ConceptView], n: int) -> str:
    """The name of a concept; nothing for a null name or an unknown id."""
    return (known[n].concept_name if n in known else None) or ""


def _code(known: dict[int, ConceptView], n: int) -> str:
    c = known.get(n)
    return f"{(c.vocabulary_id if c else None) or ''}:{(c.concept_code if c else None) or ''}"


def _by_predicate(edges):
    ordered = sorted(edges, key=lambda e: (e.predicate_id, e.object_id))
    return [(p, list(own)) for p, own in groupby(ordered, key=lambda e: e.predicate_id)]


def subgraph_text(kg, graph: Subgraph) -> str:
    known = _names(kg, graph.nodes)
    lines = ["Subgraph:", f"  Nodes: {len(graph.nodes)}", f"  Edges: {len(graph.edges)}", ""]
    return "\n".join(lines + [f"- {_name(known, n)} ({_code(known, n)})" for n in sorted(graph.nodes)])


def path_text(kg, path: GraphPath) -> str:
    known = _names(kg, path.nodes())
    return "\n".join(f"{_name(known, s.subject)} --[{s.predicate}]--> {_name(known, s.object)}" for s in path.steps)


def trace_text(kg, trace: GraphTrace) -> str:
    known = _names(kg, [s.node for s in trace.steps] + [e.object_id for s in trace.steps for e in s.expanded_edges])
    out = []
    for step in trace.steps:
        out.append(f"[depth {step.depth}] {_name(known, step.node)}")
        for predicate, edges in _by_predicate(step.expanded_edges):
            out.append(f"    └─ {kg.predicate_name(predicate)}")
            out += [f"        → {_name(known, e.object_id)}" for e in edges[:TEXT_TARGETS]]
            if len(edges) > TEXT_TARGETS:
                out.append(f"        … {len(edges) - TEXT_TARGETS} more")
    if trace.terminated_reason:
        out.append(f"[terminated: {trace.terminated_reason}]")
    return "\n".join(out)


def explained_path_text(kg, explanation: PathExplanation) -> str:
    known = _names(kg, explanation.path.nodes())
    lines = [f"Path rank: {explanation.profile.path_rank()}", "Steps:"]
    for s in explanation.steps:
        lines.append(f"- {_name(known, s.step.subject)} --[{s.step.predicate}]--> {_name(known, s.step.object)} ({s.kind}) {s.reason}")
    return "\n".join(lines)


def _card(c: ConceptView) -> str:
    tick = "✅" if c.invalid_reason is None else "❌"
    code = escape(f"{c.vocabulary_id or ''}:{c.concept_code or ''}")
    return f'<div class="concept"><b>{escape(c.concept_name or "")}</b> {tick}<br/><code>{code}</code><br/><small>Domain: {escape(c.domain_id or '')} · Class: {escape(c.concept_class_id or '')}</small></div>'


def concept_card(c: ConceptView) -> str:
    return _card(c)


def concept_card_compact(c: ConceptView) -> str:
    return _card(c).replace("<br/>", " · ")


def subgraph_html(kg, graph: Subgraph) -> str:
    known = _names(kg, sorted(graph.nodes)[:CARDS])
    cards = "".join(_card(known[n]) for n in sorted(known))
    return f"<div><h4>Subgraph</h4><p>Nodes: {len(graph.nodes)} · Edges: {len(graph.edges)}</p>{cards}</div>"


def trace_html(kg, trace: GraphTrace) -> str:
    known = _names(kg, [s.node for s in trace.steps] + [e.object_id for s in trace.steps for e in s.expanded_edges])
    out = []
    for step in trace.steps:
        out.append(f"<div><div>[depth {step.depth}]</div>{concept_card_compact(known[step.node])}")
        for predicate, edges in _by_predicate(step.expanded_edges):
            out.append(f"<div>└─ {escape(kg.predicate_name(predicate) or '')}</div>")
            out += [f"<div>→ {escape(_name(known, e.object_id))}</div>" for e in edges[:HTML_TARGETS]]
            if len(edges) > HTML_TARGETS:
                out.append(f"<div>… {len(edges) - HTML_TARGETS} more</div>")
        out.append("</div>")
    if trace.terminated_reason:
        out.append(f"<div>[terminated: {escape(trace.terminated_reason)}]</div>")
    return f"<div>{''.join(out)}</div>"


def path_html(kg, path: GraphPath) -> str:
    known = _names(kg, path.nodes())
    return "<br/>".join(f"{escape(_name(known, s.subject))} <b>--[{escape(s.predicate)}]--></b> {escape(_name(known, s.object))}" for s in path.steps)


def explained_path_html(kg, explanation: PathExplanation) -> str:
    known = _names(kg, explanation.path.nodes())
    head = "".join(f"<th>{h}</th>" for h in ("From", "Predicate", "To", "Kind", "Reason"))
    rows = [(_name(known, s.step.subject), s.step.predicate, _name(known, s.step.object), s.kind, s.reason) for s in explanation.steps]
    body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in row) + "</tr>" for row in rows)
    return f"<div><h4>Path explanation (rank={explanation.profile.path_rank()})</h4><table><tr>{head}</tr>{body}</table></div>"


def _quoted(text: str | None) -> str:
    return (text or "").replace('"', "#quot;")


def subgraph_mermaid(kg, graph: Subgraph) -> str:
    known = _names(kg, graph.nodes)
    lines = ["graph TD"] + [f'  {n}["{_quoted(_name(known, n))}\\n{_code(known, n)}"]' for n in sorted(graph.nodes)]
    return "\n".join(lines + [f"  {e.subject_id} -->|{kg.predicate_name(e.predicate_id)}| {e.object_id}" for e in graph.edges])


def path_mermaid(kg, path: GraphPath) -> str:
    known = _names(kg, path.nodes())
    return "\n".join(["graph LR"] + [f'{s.subject}["{_quoted(_name(known, s.subject))}"] -->|{s.predicate}| {s.object}["{_quoted(_name(known, s.object))}"]' for s in path.steps])


_BY_FORMAT = {
    "subgraph": {"html": subgraph_html, "mmd": subgraph_mermaid, "text": subgraph_text},
    "path": {"html": path_html, "mmd": path_mermaid, "text": path_text},
    "trace": {"html": trace_html, "text": trace_text},
    "explained": {"html": explained_path_html, "text": explained_path_text},
}


def _render(what: str, kg, value, fmt: Format) -> str:
    own = _BY_FORMAT[what]
    return own.get(_resolve(fmt), own["text"])(kg, value)


def render_subgraph(kg, graph: Subgraph, *, format: Format = "auto") -> str:
    return _render("subgraph", kg, graph, format)


def render_path(kg, path: GraphPath, *, format: Format = "auto") -> str:
    return _render("path", kg, path, format)


def render_trace(kg, trace: GraphTrace, *, format: Format = "auto") -> str:
    """Formats other than html give text."""
    return _render("trace", kg, trace, format)


def render_explained_path(kg, explanation: PathExplanation, *, format: Format = "auto") -> str:
    """Formats other than html give text."""
    return _render("explained", kg, explanation, format)


def bind_default_renderers(kg) -> None:
    """Lets notebooks show subgraphs, traces and paths of ``kg`` as HTML."""
    for cls, function in ((Subgraph, subgraph_html), (GraphTrace, trace_html), (GraphPath, path_html)):
        cls._repr_html_ = lambda self, function=function: function(kg, self)

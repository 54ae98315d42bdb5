"""Tables of the vocabulary for a document, and whether a document still holds them."""

from __future__ import annotations

from pathlib import Path

from casegraph.functions import vocab


def _table(head: list[str], rows: list[tuple]) -> str:
    lines = [f"| {' | '.join(head)} |", "|" + "-|" * len(head)]
    return "\n".join(lines + ["| " + " | ".join(str(x) for x in r) + " |" for r in rows])


def tables() -> str:
    """Node types, relations by origin, rules, limits and triggers, as Markdown."""
    yes = lambda b: "sí" if b else "no"
    parts = [
        ("Tipos de nodo", _table(["tipo"], [(t,) for t in vocab.NODE_TYPES])),
        ("Relaciones", _table(["relación", "origen", "estado inicial"], [(r, o, vocab.FIRST_STATE[o]) for r, o in vocab.ORIGIN.items()])),
        ("Reglas", _table(["regla", "nodo", "peso", "solo corrobora", "pierde peso por frecuencia"], [(r.name, r.kind, r.weight, yes(r.corroborates), yes(r.discriminates)) for r in vocab.RULES])),
        ("Pares por identificador", _table(["tipo", "máximo"], [*vocab.PAIR_CAPS.items(), ("otros", vocab.DEFAULT_CAP)])),
        ("Disparadores de alertas", _table(["motivo", "aportes", "prioridad"], [(m, ", ".join(c), p) for m, (c, p) in vocab.TRIGGERS.items()])),
    ]
    return "\n\n".join(f"## {t}\n\n{b}" for t, b in parts) + "\n"


def stale(path: str) -> bool:
    """Whether a document lacks the tables as they are now."""
    return tables() not in Path(path).read_text(encoding="utf-8")

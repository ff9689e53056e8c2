"""Reading of Spark's plan text: lists, calls, sort orders."""

from __future__ import annotations

_OPEN, _SHUT = "([{<", ")]}>"


def split_top(text: str, mark: str = ",") -> list[str]:
    """Parts between marks that stand in no bracket, stripped; an arrow's > closes nothing."""
    parts, depth, begin = [], 0, 0
    for i, c in enumerate(text):
        if c in _OPEN and not (c == "<" and text[i + 1 : i + 2] in ("", " ", "=", ">")):
            depth += 1
        elif c in _SHUT and depth and not (c == ">" and (text[i - 1] in "-= " or text[i + 1 : i + 2] == "=")):
            depth -= 1
        elif c == mark and depth == 0:
            parts.append(text[begin:i].strip())
            begin = i + 1
    parts.append(text[begin:].strip())
    return [p for p in parts if p]


def unbracket(text: str) -> str:
    text = text.strip()
    return text[1:-1].strip() if text[:1] == "[" and text[-1:] == "]" else text


def listed(text: str | None) -> list[str] | None:
    """Entries of "[a, f(b, c), d AS e]"; None where there are none."""
    return None if text is None else split_top(unbracket(text)) or None


def call(text: str) -> dict:
    """A function and its arguments as text: count(1) gives count and 1, row_number() gives None."""
    name, _, rest = text.partition("(")
    inner = rest[: rest.rfind(")")].strip() if rest else ""
    return {"function": name.strip(), "col": inner or None}


def calls(text: str | None) -> list[dict] | None:
    return [call(x) for x in listed(text) or []] or None


def ordering(text: str) -> dict:
    """A sort order like "a#1 DESC NULLS LAST"; ascending with nulls first where it doesn't say."""
    words = text.split(" ")
    for i in range(len(words) - 1, 0, -1):
        if words[i] in ("ASC", "DESC"):
            asc = words[i] == "ASC"
            tail = words[i + 1 :]
            return {"name": " ".join(words[:i]), "asc": asc, "nulls_first": tail[:2] == ["NULLS", "FIRST"] if tail else asc}
    return {"name": text, "asc": True, "nulls_first": True}


def orderings(text: str | None) -> list[dict]:
    return [ordering(x) for x in listed(text) or []]


def whole(text: str | None) -> int | None:
    try:
        return int(str(text).strip())
    except ValueError:
        return None


def truth(text: str | None) -> bool | None:
    return {"true": True, "false": False}.get(str(text).strip().lower())

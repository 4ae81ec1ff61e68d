"""Plain single-process versions of operators, to hold results against."""

from __future__ import annotations

import hashlib
import re


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def ascii_lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pii(docs: list[tuple]) -> list[tuple]:
    """(id, counts of the four kinds, digest of base spans) per document."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for doc_id, text in docs:
        spans, counts = [], []
        for rank, (kind, pattern) in enumerate(patterns.items()):
            n = 0
            for m in re.finditer(pattern, text or ""):
                digits = re.sub("[^0-9]", "", m[0])
                good = {
                    "email": lambda: True,
                    "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                    "card": lambda d=digits: 12 <= len(d) <= 19 and luhn(d),
                    "phone": lambda d=digits: 9 <= len(d) <= 15,
                }[kind]()
                if good:
                    n += 1
                    spans.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
            counts.append(n)
        out.append((doc_id, *counts, sha(",".join(s for _, _, s in sorted(spans)))))
    return out


def contamination(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    """The contract's row of each document, by looking at all windows of all items."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows: dict[tuple, set] = {}
    for item_id, text in items:
        w = word.findall(ascii_lower(text))
        n = min(10, len(w))
        for o in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[o : o + n]), set()).add(str(item_id))
    out = []
    for doc_id, text in docs:
        w = word.findall(ascii_lower(text))
        hit: set[int] = set()
        items_hit: set[str] = set()
        for n in {len(x) for x in windows}:
            for o in range(len(w) - n + 1):
                if found := windows.get(tuple(w[o : o + n])):
                    hit |= set(range(o, o + n))
                    items_hit |= found
        out.append((doc_id, len(w), len(hit), len(items_hit), sha(",".join(sorted(items_hit))), bool(hit)))
    return out


def without_tags(page):
    """The text of a page without tags and comments, by the states of HTML's tokenizer."""
    blank, out, i, n = " \t\n\r\f", [], 0, len(page)
    letter = lambda k: k < n and page[k].isascii() and page[k].isalpha()
    while i < n:
        if page.startswith("<!--", i):
            i += 4
            if page.startswith(">", i) or page.startswith("->", i):
                i = page.index(">", i) + 1
                continue
            ends = [(k, len(e)) for e in ("-->", "--!>") if (k := page.find(e, i)) >= 0]
            i = sum(min(ends)) if ends else n
        elif page[i] == "<" and i + 1 < n and (page[i + 1] in "!?" or (page[i + 1] == "/" and i + 2 < n and not letter(i + 2))):
            k = page.find(">", i)
            i = k + 1 if k >= 0 else n
        elif page[i] == "<" and (letter(i + 1) or (page.startswith("</", i) and letter(i + 2))):
            i, state = i + 1, "name"
            while i < n:
                c = page[i]
                if state == "value start":
                    if c in blank:
                        i += 1
                        continue
                    state = {'"': '"', "'": "'"}.get(c, "before" if c == ">" else "unquoted")
                    if state in ('"', "'", "unquoted"):
                        i += 1
                        continue
                if state in ('"', "'"):
                    state = "before" if c == state else state
                elif c == ">":
                    break
                elif state == "unquoted":
                    state = "before" if c in blank else state
                elif state == "name":
                    state = "before" if c in blank or (c == "/" and page[i - 1] != "<") else state
                elif state == "attribute":
                    state = "value start" if c == "=" else "after" if c in blank else "before" if c == "/" else state
                elif state == "after":
                    state = "value start" if c == "=" else state if c in blank else "before" if c == "/" else "attribute"
                elif c not in blank + "/":
                    state = "attribute"
                i += 1
            i += 1
        else:
            out.append(page[i])
            i += 1
    return "".join(out)

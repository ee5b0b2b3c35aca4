"""Marks of citation lists by one scan over characters, to test the pattern against."""

LARGEST_MARK, MARK_DIGITS, LIST_LENGTH = 30, 2, 5
DIGITS = frozenset("0123456789")


def _listed(text: str, at: int, digits: int | None, most: int | None) -> list[tuple[str, int]]:
    """Numbers with commas between them from ``at`` on, each with the place after it."""
    found: list[tuple[str, int]] = []
    while most is None or len(found) < most:
        end = at
        while end < len(text) and text[end] in DIGITS:
            end += 1
        if end == at or (digits is not None and end - at > digits):
            break
        found.append((text[at:end], end))
        at = end
        while at < len(text) and text[at].isspace():
            at += 1
        if text[at : at + 1] != ",":
            break
        at += 1
        while at < len(text) and text[at].isspace():
            at += 1
    return found


def _ends_list(text: str, at: int) -> bool:
    """Whether a bare list may end here: before a stop that opens no decimal, a comma, a line end, a dash or a mark."""
    line_end = "\n" in text[at : at + 1]
    while at < len(text) and text[at].isspace():
        line_end |= text[at] == "\n"
        at += 1
    rest = text[at : at + 2]
    return line_end or rest == "" or rest[0] in ",;[" or rest == "--" or (rest[0] == "." and rest[1:] not in DIGITS)


def _opens_sentence(text: str, at: int) -> bool:
    end = at
    while end < len(text) and text[end].isspace():
        end += 1
    return end > at and text[end : end + 1].isascii() and text[end : end + 1].isalpha()


def normalize_one(text: str | None) -> str | None:
    """Lists at a line's start, lists in brackets and bare lists after a word, all as [n] marks.

    Outside brackets numbers above 30 are no citations, and a list without a citation, like every decimal, is
    left alone; a list may be shorter than what stands there if only its first numbers end well. A null stays
    null. One scan from left to right.
    """
    if text is None:
        return None
    out: list[str] = []
    at, n = 0, len(text)
    while at < n:
        c = text[at]
        if c == "[":
            found = _listed(text, at + 1, None, None)
            if len(found) > 1 and text[found[-1][1] : found[-1][1] + 1] == "]":
                out += [f"[{x}]" for x, _ in found]
                at = found[-1][1] + 1
                continue
        elif c in DIGITS:
            found = _listed(text, at, MARK_DIGITS, LIST_LENGTH)
            starts = at == 0 or text[at - 1] == "\n"
            follows = at > 1 and text[at - 1] == " " and (text[at - 2] in ")]%" or (text[at - 2].isascii() and text[at - 2].isalpha()))
            ok = [k for k, (_, end) in enumerate(found, 1) if (starts and k > 1 and _opens_sentence(text, end)) or (follows and _ends_list(text, end))]
            marks = [f"[{x}]" for x, _ in found[: max(ok, default=0)] if 1 <= int(x) <= LARGEST_MARK]
            if marks:
                out += marks
                at = found[max(ok) - 1][1]
                continue
            end = at
            while end < n and text[end] in DIGITS:
                end += 1
            out.append(text[at:end])
            at = end
            continue
        out.append(c)
        at += 1
    return "".join(out)

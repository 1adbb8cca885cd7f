"""What a voice can say of a text with markdown: one scan that pairs marks and drops them."""

from __future__ import annotations

from itertools import groupby

BLANKS = " \t"
EMPHASIS = "*_"
BULLETS = "-*+"
HEADING, DEEPEST = "#", 6


def unlink(text: str) -> str:
    """A bracketed label followed by a bracketed target becomes the label."""
    if "](" not in text:
        return text
    out, at = [], 0
    while (start := text.find("[", at)) >= 0:
        close = text.find("]", start)
        end = text.find(")", close) if text.startswith("](", close) and close > 0 else -1
        if end < 0:
            out.append(text[at : start + 1])
            at = start + 1
        else:
            out += [text[at:start], text[start + 1 : close]]
            at = end + 1
    return "".join(out) + text[at:]


def line_body(line: str) -> str:
    """A line without its opening marks: a heading, then a bullet, then a number."""
    inner = line.lstrip(BLANKS)
    if inner.startswith(HEADING):
        depth = len(inner) - len(inner.lstrip(HEADING))
        line = inner = inner[min(depth, DEEPEST) :].lstrip(BLANKS)
    if inner[:1] and inner[0] in BULLETS and inner[1:2] and inner[1] in BLANKS:
        line = inner = inner[1:].lstrip(BLANKS)
    mark = inner.replace("\t", " ").partition(" ")
    if mark[1] and mark[0][-1:] in (".", ")") and mark[0][:-1].isdecimal():
        line = inner[len(mark[0]) :].lstrip(BLANKS)
    return line


def unemphasise(line: str) -> str:
    """Runs of stars or underscores that hug what stands between them go in pairs.

    A run opens before a character that is no space and closes behind one; a closing run is
    paired with the latest open runs of its kind, of which as many marks go as both have.
    What finds no partner stays.
    """
    runs, at = [], 0
    for char, same in groupby(line):
        size = sum(1 for _ in same)
        if char in EMPHASIS:
            runs.append([char, at, size])
        at += size
    if len(runs) < 2:
        return line
    left: dict[int, int] = {}
    waiting: dict[str, list[int]] = {mark: [] for mark in EMPHASIS}
    for i, (char, at, size) in enumerate(runs):
        stack = waiting[char]
        if at and not line[at - 1].isspace():
            while size and stack:
                other = stack[-1]
                paired = min(size, left[other])
                size -= paired
                left[other] -= paired
                if not left[other]:
                    stack.pop()
        left[i] = size
        after = at + runs[i][2]
        if size and after < len(line) and not line[after].isspace():
            stack.append(i)
    out, done = [], 0
    for i, (char, at, size) in enumerate(runs):
        out += [line[done:at], char * left[i]]
        done = at + size
    return "".join(out) + line[done:]


def untick(text: str) -> str:
    """Code ticks go in pairs; an odd last one stays."""
    parts = text.split("`")
    if len(parts) % 2 == 0:
        parts[-2:] = ["`".join(parts[-2:])]
    return "".join(parts)


def narrow(line: str) -> str:
    """Two or more blanks in a row become one space."""
    if "\t" not in line and "  " not in line:
        return line
    runs = ((blank, "".join(part)) for blank, part in groupby(line, BLANKS.__contains__))
    return "".join(" " if blank and len(part) > 1 else part for blank, part in runs)


def spoken(text: str) -> str:
    bodies = (unemphasise(line_body(line)) for line in unlink(text).split("\n"))
    lines = (narrow(line) for line in untick("\n".join(bodies)).split("\n"))
    return "\n".join(line for line in lines if line).strip()

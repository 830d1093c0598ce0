"""Patterns of users in RE2 syntax as Java patterns of the same meaning.

The reference compiles patterns with an RE2 engine and skips those it rejects. ``to_java`` reads a pattern by that grammar
and either rejects it (lookaround, backreferences, possessive or repeated quantifiers, escapes RE2 does not know, ...) or
writes it so that Java's engine reads the same: every literal escaped (``&&`` and ``[`` inside a class are plain characters
in RE2), ``$`` as the end of the text and not before a last line break, ``.`` as anything but ``\\n``, ``\\s`` without the
vertical tab, word boundaries on ASCII, groups without capture.

Read: literals, classes with ranges, ``\\d \\s \\w`` and POSIX names, ``\\p`` with general categories and the scripts below,
groups with flags ``imsU``, repetition, ``\\Q...\\E``, octal and hex escapes, ``^ $ \\A \\z \\b \\B``. A pattern with any other
script is rejected.
"""

from __future__ import annotations

CATEGORIES = frozenset("C Cc Cf Co Cs L Ll Lm Lo Lt Lu M Mc Me Mn N Nd Nl No P Pc Pd Pe Pf Pi Po Ps S Sc Sk Sm So Z Zl Zp Zs".split())
SCRIPTS = frozenset("Arabic Armenian Bengali Cyrillic Devanagari Georgian Greek Han Hangul Hebrew Hiragana Katakana Latin Thai".split())
POSIX = {"alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x{0}-\x{7f}", "blank": r"\x{9} ", "cntrl": r"\x{0}-\x{1f}\x{7f}",
         "digit": "0-9", "graph": r"\x{21}-\x{7e}", "lower": "a-z", "print": r"\x{20}-\x{7e}",
         "punct": r"\x{21}-\x{2f}\x{3a}-\x{40}\x{5b}-\x{60}\x{7b}-\x{7e}", "space": r"\x{9}-\x{d} ", "upper": "A-Z",
         "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f"}
PERL = {"d": "0-9", "s": r"\x{9}\x{a}\x{c}\x{d} ", "w": "0-9A-Za-z_"}
CONTROLS = {"a": 7, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11}
WORD = "[0-9A-Za-z_]"
EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
NO_EDGE = f"(?:(?<={WORD})(?={WORD})|(?<!{WORD})(?!{WORD}))"
MOST = 1000  # of a counted repetition


class Rejected(ValueError):
    """RE2 does not compile the pattern."""


def _literal(code: int) -> str:
    char = chr(code)
    return char if char.isascii() and char.isalnum() else rf"\x{{{code:x}}}"


class _Reader:
    def __init__(self, pattern: str):
        self.text, self.at, self.names = pattern, 0, set()

    def peek(self, size: int = 1) -> str:
        return self.text[self.at:self.at + size]

    def take(self, size: int = 1) -> str:
        got = self.peek(size)
        if len(got) < size:
            raise Rejected("unexpected end")
        self.at += size
        return got

    def until(self, end: str) -> str:
        stop = self.text.find(end, self.at)
        if stop < 0:
            raise Rejected(f"no {end}")
        got, self.at = self.text[self.at:stop], stop + len(end)
        return got

    # ------------------------------------------------------------------------------- expressions
    def alternatives(self, flags: frozenset, depth: int) -> str:
        """Alternatives up to the end of the pattern or of the group; flags may change on the way."""
        if depth > MOST:
            raise Rejected("nested too deeply")
        out, last = [], None  # last: place of what a repetition would repeat
        repeated = False
        while self.peek():
            char = self.peek()
            if char == ")":
                if depth == 0:
                    raise Rejected("unexpected )")
                break
            if char == "|":
                out.append(self.take())
                last, repeated = None, False
                continue
            count = self.repetition()
            if count is not None:
                if last is None or repeated:
                    raise Rejected("nothing to repeat, or a repetition of a repetition")
                lazy = self.peek() == "?"
                if lazy:
                    self.take()
                out.append(count + ("?" if lazy != ("U" in flags) else ""))
                repeated = True
                continue
            if char == "(" and (change := self.flag_change(flags)) is not None:
                flags, mark = change
                out.append(mark)
                last, repeated = None, False
                continue
            if made := self.atom(flags, depth):  # an empty quotation leaves what stands before it
                last, repeated = len(out), False
                out.append(made)
        return "".join(out)

    def repetition(self) -> str | None:
        char = self.peek()
        if char and char in "*+?":
            return self.take()
        if char != "{":
            return None
        stop = self.text.find("}", self.at)
        low, comma, high = self.text[self.at + 1:stop].partition(",") if stop > 0 else ("", "", "")
        if not low.isascii() or not low.isdigit() or (high and not (high.isascii() and high.isdigit())):
            return None  # no repetition: the brace is a character
        self.at = stop + 1
        if int(low) > MOST or (high and (int(high) > MOST or int(high) < int(low))):
            raise Rejected("repetition out of range")
        return "{" + str(int(low)) + comma + (str(int(high)) if high else "") + "}"

    def flag_change(self, flags: frozenset):
        """(flags, Java mark) of ``(?flags)``, which holds to the end of the group; None where another group begins."""
        stop = self.text.find(")", self.at)
        inside = self.text[self.at + 1:stop] if stop > 0 else ""
        if not inside.startswith("?") or not set(inside[1:]) <= set("imsU-"):
            return None
        self.at = stop + 1
        flags = self.flags(flags, inside[1:])
        return flags, "(?iu)" if "i" in flags else "(?-iu)"

    def flags(self, flags: frozenset, text: str) -> frozenset:
        on, dash, off = text.partition("-")
        if "-" in off or (dash and not off):
            raise Rejected("bad flags")
        return (flags | set(on)) - set(off)

    def atom(self, flags: frozenset, depth: int) -> str:
        char = self.take()
        if char == "(":
            return self.group(flags, depth)
        if char == "[":
            return self.char_class()
        if char == ".":
            return r"[\x{0}-\x{10ffff}]" if "s" in flags else r"[^\x{a}]"
        if char == "^":
            return r"(?<![^\x{a}])" if "m" in flags else r"\A"
        if char == "$":
            return r"(?![^\x{a}])" if "m" in flags else r"\z"
        if char == "\\":
            return self.escape(in_class=False)
        return _literal(ord(char))

    def group(self, flags: frozenset, depth: int) -> str:
        mark = ""
        if self.peek() == "?":
            if self.peek(3) == "?P<" or (self.peek(2) == "?<" and self.peek(3) not in ("?<=", "?<!")):
                self.take(3 if self.peek(3) == "?P<" else 2)
                name = self.until(">")
                if not name or not all(c.isascii() and (c.isalnum() or c == "_") for c in name) or name in self.names:
                    raise Rejected("bad group name")
                self.names.add(name)
            else:
                self.take()
                text = self.until(":")
                if not set(text) <= set("imsU-"):
                    raise Rejected("unknown group")
                flags = self.flags(flags, text) if text else flags
                mark = "(?iu)" if "i" in flags else "(?-iu)"
        inside = self.alternatives(flags, depth + 1)
        if self.peek() != ")":
            raise Rejected("no )")
        self.take()
        return f"(?:{mark}{inside})"

    # ------------------------------------------------------------------------------- characters
    def code(self, char: str) -> int | None:
        """Code point of an escape that stands for one character."""
        if char in CONTROLS:
            return CONTROLS[char]
        if char == "x":
            digits = self.until("}") if self.peek() == "{" and self.take() else self.take(2)
            if not digits or any(c not in "0123456789abcdefABCDEF" for c in digits) or int(digits, 16) > 0x10FFFF:
                raise Rejected("bad hex escape")
            return int(digits, 16)
        if char in "01234567" and (char == "0" or (self.peek() and self.peek() in "01234567")):
            digits = char
            while len(digits) < 3 and self.peek() and self.peek() in "01234567":
                digits += self.take()
            return int(digits, 8)
        if char.isascii() and not char.isalnum():
            return ord(char)
        return None

    def escape(self, in_class: bool) -> str:
        """A class's content, or an expression, for what follows a backslash."""
        char = self.take()
        if char.lower() in PERL:
            inside = PERL[char.lower()]
            return f"[{'^' if char.isupper() else ''}{inside}]" if not in_class or char.isupper() else inside
        if char in "pP":
            name = self.until("}") if self.peek() == "{" and self.take() else self.take()
            negated = (char == "P") != name.startswith("^")
            name = name.removeprefix("^")
            if name not in CATEGORIES | SCRIPTS | {"Any"}:
                raise Rejected("unknown class")
            known = r"\x{0}-\x{10ffff}" if name == "Any" else rf"\p{{{'Is' * (name in SCRIPTS)}{name}}}"
            return f"[{'^' * negated}{known}]"
        if not in_class:
            if char == "Q":
                stop = self.text.find("\\E", self.at)
                body = self.text[self.at:stop if stop >= 0 else None]
                self.at = stop + 2 if stop >= 0 else len(self.text)
                return "".join(_literal(ord(c)) for c in body)
            if char in "AzbB":
                return {"A": r"\A", "z": r"\z", "b": EDGE, "B": NO_EDGE}[char]
        if (code := self.code(char)) is None:
            raise Rejected("unknown escape")
        return _literal(code)

    def char_class(self) -> str:
        """``[...]``: a Java union whose members are all escaped."""
        negated = self.peek() == "^"
        if negated:
            self.take()
        parts, first = [], True
        while first or self.peek() != "]":
            if not self.peek():
                raise Rejected("no ]")
            if self.peek(2) == "[:" and (stop := self.text.find(":]", self.at)) > 0:
                name = self.text[self.at + 2:stop]
                if name.removeprefix("^") not in POSIX:
                    raise Rejected("unknown class")
                self.at = stop + 2
                inside = POSIX[name.removeprefix("^")]
                parts.append(f"[^{inside}]" if name.startswith("^") else inside)
            elif self.peek() == "\\" and self.peek(2)[1:].lower() in {*PERL, "p"}:
                self.take()
                parts.append(self.escape(in_class=True))
            else:
                low = self.single()
                high = low
                if self.peek() == "-" and self.peek(2) != "-]" and len(self.peek(2)) == 2:
                    self.take()
                    high = self.single()
                    if high < low:
                        raise Rejected("bad range")
                parts.append(_literal(low) if low == high else f"{_literal(low)}-{_literal(high)}")
            first = False
        self.take()
        return f"[{'^' * negated}{''.join(parts)}]"

    def single(self) -> int:
        char = self.take()
        if char != "\\":
            return ord(char)
        if (code := self.code(self.take())) is None:
            raise Rejected("unknown escape")
        return code


def to_java(pattern: str) -> str | None:
    """The Java pattern that finds what RE2 finds, None where RE2 does not compile the pattern."""
    try:
        return _Reader(pattern).alternatives(frozenset(), 0)
    except Rejected:
        return None

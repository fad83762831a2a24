"""Messages of chat export pages.

A small element tree on the standard library's tokenizer: void elements hold
nothing, an end tag closes up to its match and is ignored without one.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

#: Elements without content, and those whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(("script", "style", "template"))


class Element:
    def __init__(self, tag: str, attrs: list[tuple[str, str | None]]):
        self.tag, self.attrs, self.inner = tag, {k: v or "" for k, v in attrs}, []
        self.classes = self.attrs.get("class", "").split()

    def below(self) -> Iterator[Element]:
        """All elements inside, in document order."""
        todo = [x for x in reversed(self.inner) if isinstance(x, Element)]
        while todo:
            e = todo.pop()
            yield e
            todo += [x for x in reversed(e.inner) if isinstance(x, Element)]

    def first(self, test) -> Element | None:
        return next((e for e in self.below() if e.tag == "div" and test(e)), None)

    def strings(self) -> Iterator[str]:
        """Texts inside, but those of scripts, styles and templates."""
        todo = list(reversed(self.inner))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in HIDDEN:
                todo += list(reversed(x.inner))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__()
        self.root = Element("", [])
        self.open = [self.root]
        self.text: list[str] = []

    def flush(self):
        if self.text:
            joined = "".join(self.text)
            self.text = []
            if not joined.strip(" \t\n\r\f\v") and not any(e.tag in ("pre", "textarea") for e in self.open):
                joined = "\n" if "\n" in joined else " "
            self.open[-1].inner.append(joined)

    def handle_starttag(self, tag, attrs):
        self.flush()
        e = Element(tag, attrs)
        self.open[-1].inner.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.flush()
        at = max((i for i, e in enumerate(self.open) if i and e.tag == tag), default=0)
        if at:
            del self.open[at:]

    def handle_data(self, data):
        self.text.append(data)

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_pi = unknown_decl = handle_comment


def parse(page: str) -> Element:
    tree = _Tree()
    tree.feed(page)
    tree.close()
    tree.flush()
    return tree.root


def messages(page: str) -> list[tuple[str, str, str]]:
    """(date, sender, text) of each message that has a body and a text, nested ones too, in document order.

    Date is the title of an element whose class reads ``pull_right date
    details``, else ``?``; without a name the sender is ``System``.
    """
    token = lambda name: lambda e: name in e.classes
    out = []
    for m in parse(page).below():
        if m.tag != "div" or "message" not in m.classes or m.first(token("body")) is None:
            continue
        date = m.first(lambda e: e.classes == ["pull_right", "date", "details"])
        name, text = m.first(token("from_name")), m.first(token("text"))
        if text is not None:
            sender = "System" if name is None else "".join(name.strings()).strip()
            out.append((date.attrs.get("title", "?") if date is not None else "?", sender, " ".join(text.strings()).strip()))
    return out

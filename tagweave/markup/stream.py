"""Elements of a document as soon as they are complete, while the rest has not been read."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from tagweave.markup import match
from tagweave.markup.tree import Document, HtmlBuilder, Node, XmlBuilder
from tagweave.plans import selector


class StreamParser:
    """An element is complete when an element follows it or its parent ends. Iterating yields each once, the
    root of the document last; what has been read is in ``document``."""

    def __init__(self, html: str, base_uri: str = "", mode: str = "html", context: str | None = None, errors: list | None = None):
        self.builder = XmlBuilder(html or "", base_uri, errors) if mode == "xml" else HtmlBuilder(html or "", base_uri, context, errors)
        self.builder.fresh = []
        self.queue: deque[Node] = deque()
        self.emitted: set[int] = set()
        self.open: list[Node] = []
        self.running = True

    @property
    def document(self) -> Document:
        return self.builder.doc

    @property
    def read(self) -> int:
        """How much of the markup has been read."""
        return self.builder.tokens.at

    def _emit(self, e: Node | None) -> None:
        if e is None or id(e) in self.emitted:
            return
        todo = [(e, False)]
        while todo:  # what is below and has not been told of comes first
            n, ready = todo.pop()
            if ready:
                self.emitted.add(id(n))
                self.queue.append(n)
            elif id(n) not in self.emitted:
                todo.append((n, True))
                todo.extend((c, False) for c in reversed(n.elements()))

    @staticmethod
    def _last(n: Node) -> Node | None:
        return next((c for c in reversed(n.children) if c.kind == "element"), None)

    def _advance(self) -> None:
        builder = self.builder
        more = builder.step()
        for n in builder.fresh:
            siblings, at = n.parent.children if n.parent is not None else [], -1
            if siblings:
                at = n.index()
            self._emit(next((siblings[k] for k in range(at - 1, -1, -1) if siblings[k].kind == "element"), None))
        builder.fresh.clear()
        now = builder.stack
        if not (len(now) >= len(self.open) and (not self.open or now[len(self.open) - 1] is self.open[-1])):
            still = {id(n) for n in now}
            for n in reversed(self.open):
                if id(n) not in still:
                    self._emit(self._last(n))
        self.open = list(now) if len(now) != len(self.open) or (now and now[-1] is not self.open[-1]) else self.open
        if not more:
            self.running = False
            self._emit(self._last(self.document))
            self.emitted.add(id(self.document))
            self.queue.append(self.document)

    def __iter__(self) -> Iterator[Node]:
        while self.queue or self.running:
            while not self.queue and self.running:
                self._advance()
            if self.queue:
                yield self.queue.popleft()

    def stop(self) -> None:
        """Read no further."""
        self.running = False
        self.queue.clear()

    def close(self) -> None:
        self.stop()

    def __enter__(self) -> StreamParser:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def complete(self) -> Document:
        """The whole document."""
        while self.running:
            self._advance()
        return self.document

    def complete_fragment(self) -> list[Node]:
        """The nodes of a fragment, if a context was given, else of the document."""
        doc = self.complete()
        return list(doc.children[0].children) if getattr(self.builder, "context", None) is not None else list(doc.children)

    def _matches(self, plan, e: Node) -> bool:
        return e.kind == "element" and match.Matcher(self.document, self.document.base_uri).test(plan, e)

    def select_next(self, css: str) -> Node | None:
        """The next element to be complete that matches; reads no further than it must."""
        plan = selector.parse(css)
        return next((e for e in self if self._matches(plan, e)), None)

    def select_first(self, css: str) -> Node | None:
        """The first match in what has been read, else the next to come."""
        found = match.select(self.document, css, self.document.base_uri, True)
        return found[0] if found else self.select_next(css)

    def expect_next(self, css: str) -> Node:
        if (found := self.select_next(css)) is None:
            raise LookupError(f"no further element matches {css!r}")
        return found

    def expect_first(self, css: str) -> Node:
        if (found := self.select_first(css)) is None:
            raise LookupError(f"no element matches {css!r}")
        return found

"""Documents in memory: nodes, and the builders that make them from tokens."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from tagweave.markup import tags as T
from tagweave.markup.tokeniser import Token, Tokeniser

HTML, SVG, MATHML = "html", "svg", "mathml"


class Node:
    """kind: document element text cdata data comment declaration doctype."""

    __slots__ = ("kind", "tag", "raw_tag", "ns", "attrs", "value", "parent", "children", "form", "start", "end", "closed", "ranges", "pseudo")

    def __init__(self, kind: str, tag: str = "", attrs=(), value: str = "", ns: str = HTML, raw_tag: str | None = None, start: int = -1, end: int = -1):
        self.kind, self.tag, self.ns, self.value = kind, tag, ns, value
        self.raw_tag = tag if raw_tag is None else raw_tag
        self.attrs: list[tuple[str, str | None]] = list(attrs)
        self.parent: Node | None = None
        self.children: list[Node] = []
        self.form: Node | None = None
        self.start, self.end = start, end
        self.closed = False  # written as closed by itself
        self.pseudo = False  # stands for a text of its parent; not written
        self.ranges: tuple = ()  # (name, start and end of the name, of the value) of attributes in the source

    def attr(self, name: str) -> str | None:
        """Value of the first attribute of that name in any case; ``None`` if there is none."""
        name = name.lower()
        return next((v or "" for k, v in self.attrs if k.lower() == name), None)

    def append(self, child: Node, before: int | None = None) -> Node:
        child.remove()
        child.parent = self
        self.children.insert(len(self.children) if before is None else before, child)
        return child

    def remove(self) -> None:
        if self.parent is not None:
            del self.parent.children[self.index()]
            self.parent = None

    def index(self) -> int:
        """The place among its parent's children, looked for from the end, where changes are made while parsing."""
        siblings = self.parent.children
        return next(k for k in range(len(siblings) - 1, -1, -1) if siblings[k] is self)

    def walk(self) -> Iterator[Node]:
        """This node and all below it in document order; without recursion, documents may be deep."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.children))

    def elements(self) -> list[Node]:
        return [c for c in self.children if c.kind == "element"]

    def copy(self) -> Node:
        """This node without its children."""
        new = Node(self.kind, self.tag, self.attrs, self.value, self.ns, self.raw_tag)
        new.closed, new.pseudo = self.closed, self.pseudo
        return new

    def same_value(self, other: Node) -> bool:
        """Whether both stand for the same markup: kinds, names, attributes and contents, not places."""
        todo = [(self, other)]
        while todo:
            a, b = todo.pop()
            if (a.kind, a.raw_tag, a.attrs, a.value, len(a.children)) != (b.kind, b.raw_tag, b.attrs, b.value, len(b.children)):
                return False
            todo.extend(zip(a.children, b.children, strict=True))
        return True

    def deep_copy(self) -> Node:
        top = self.copy()
        todo = [(self, top)]
        while todo:
            old, new = todo.pop()
            for c in old.children:
                todo.append((c, new.append(c.copy())))
        return top


class Document(Node):
    __slots__ = ("base_uri", "quirks", "errors", "xml")

    def __init__(self, base_uri: str = "", xml: bool = False):
        super().__init__("document", "#root", ns="xml" if xml else HTML)
        self.base_uri, self.quirks, self.errors, self.xml = base_uri, False, [], xml


def written(t: Token) -> str:
    """A token as markup."""
    if t.kind == "start":
        return f"<{t.name}{''.join(f'  {k}' if v is None else f'  {k}={chr(34)}{v}{chr(34)}' for k, v in t.attrs)}>"
    if t.kind in ("end", "doctype", "comment"):
        return {"end": f"</{t.name}>", "doctype": f"<!doctype {t.name}>", "comment": f"<!--{t.name}-->"}[t.kind]
    return t.name


@dataclass(frozen=True)
class Settings:
    """Whether names keep their case. HTML folds both, XML keeps both."""

    keep_tag_case: bool = False
    keep_attribute_case: bool = False

    def tag(self, name: str) -> str:
        name = name.strip()
        return name if self.keep_tag_case else name.lower()

    def attribute(self, name: str) -> str:
        name = name.strip()
        return name if self.keep_attribute_case else name.lower()


FOLD, KEEP = Settings(), Settings(True, True)


def _attrs(token: Token, settings: Settings) -> list[tuple[str, str | None]]:
    """Attributes of a token, the first of each name."""
    out: dict[str, str | None] = {}
    for k, v in token.attrs:
        out.setdefault(settings.attribute(k), v)
    return list(out.items())


class XmlBuilder:
    """Elements as they are nested; an end tag closes the nearest open element of its name, if any."""

    def __init__(self, text: str, base_uri: str = "", errors: list | None = None, settings: Settings = KEEP):
        self.doc = Document(base_uri, True)
        self.tokens = Tokeniser(text, True, errors)
        self.settings = settings

        self.stack: list[Node] = [self.doc]
        self.fresh: list[Node] | None = None  # elements put into the tree, for who follows the building

    def build(self) -> Document:
        while self.step():
            pass
        return self.doc

    def step(self) -> bool:
        """One token further; false after the last."""
        stack = self.stack
        if (t := self.tokens.next()).kind != "eof":
            if t.kind == "start":
                node = stack[-1].append(Node("element", t.name.lower(), _attrs(t, self.settings), ns="xml", raw_tag=self.settings.tag(t.name), start=t.start, end=t.end))
                node.closed, node.ranges = t.closed, t.ranges
                if self.fresh is not None:
                    self.fresh.append(node)
                if not t.closed:
                    stack.append(node)
            elif t.kind == "end":
                at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].raw_tag == self.settings.tag(t.name)), 0)
                if at:
                    del stack[at:]
            elif t.kind == "doctype":
                stack[-1].append(Node("doctype", "#doctype", [("name", t.name), ("publicId", t.attrs[0]), ("systemId", t.attrs[1]), ("pubSysKey", t.attrs[2])]))
            else:
                stack[-1].append(Node(t.kind, f"#{t.kind}", value=t.name, ns="xml", start=t.start, end=t.end))
        return t.kind != "eof"


class HtmlBuilder:
    """Tree construction by insertion modes, after the HTML standard with the engine's stated departures."""

    def __init__(self, text: str, base_uri: str = "", context: str | None = None, errors: list | None = None, settings: Settings = FOLD):
        self.doc, self.settings = Document(base_uri), settings
        self.doc.errors = errors if errors is not None else []
        self.tokens = Tokeniser(text, errors=errors)
        self.stack: list[Node] = []
        self.active: list[Node | None] = []  # formatting elements; None is a marker
        self.mode, self.back_to = self.initial, self.in_body
        self.templates: list = []
        self.head: Node | None = None
        self.form: Node | None = None
        self.foster = False
        self.frames_ok = True
        self.skip_newline = False
        self.self_closed: str | None = None
        self.fresh: list[Node] | None = None  # elements put into the tree, for who follows the building
        self.base_set = False
        self.context: Node | None = None
        if context is not None:
            self._start_fragment(context)

    # -- errors

    def error(self, t: Token, state: str) -> None:
        """A token that a state of tree construction does not expect, at the place where it ends."""
        if self.tokens.errors is not None:
            kind = {"start": "StartTag", "end": "EndTag", "doctype": "Doctype", "comment": "Comment", "eof": "EOF"}.get(t.kind, "Character")
            self.tokens.error(t.end, f"Unexpected {kind} token [{written(t)}] when in state [{state}]")

    def expect(self, t: Token, name: str, state: str = "InBody") -> None:
        if not self.stack or self.stack[-1].tag != name:
            self.error(t, state)

    def left_open(self, t: Token, state: str = "InBody") -> None:
        """Whether elements are open that an end of the body does not close by itself."""
        if self.tokens.errors is not None and any(n.tag not in T.MAY_STAY_OPEN for n in self.stack):
            self.error(t, state)

    # -- running

    def build(self) -> Document:
        while self.step():
            pass
        return self.doc

    def step(self) -> bool:
        """One token further; false after the last."""
        t = self.tokens.next()
        self.process(t)
        if self.self_closed is not None:  # a tag that closes itself is a start and an end
            name, self.self_closed = self.self_closed, None
            self.process(Token("end", name, start=t.end, end=t.end))
        self.tokens.foreign = bool(self.stack) and self.stack[-1].ns in (SVG, MATHML)
        return t.kind != "eof"

    def process(self, t: Token) -> None:
        if self.skip_newline:
            self.skip_newline = False
            if t.kind == "text" and t.name.startswith("\n"):
                t = t._replace(name=t.name[1:])
        if t.kind == "text" and not t.name:
            return
        top = self.stack[-1] if self.stack else None
        if top is not None and top.ns in (SVG, MATHML) and t.kind != "eof" and not self._html_point(top, t):
            self.in_foreign(t)
        else:
            self.mode(t)

    def _html_point(self, top: Node, t: Token) -> bool:
        if top.ns == MATHML and top.tag in ("mi", "mo", "mn", "ms", "mtext"):
            return t.kind in ("text", "cdata") or (t.kind == "start" and t.name.lower() not in ("mglyph", "malignmark"))
        return top.ns == SVG and top.tag in ("foreignobject", "desc", "title") and t.kind in ("start", "text", "cdata")

    def _start_fragment(self, context: str) -> None:
        self.context = Node("element", context)
        root = self.doc.append(Node("element", "html"))
        self.stack.append(root)
        if context in ("title", "textarea"):
            self.tokens.raw = (context, True)
        elif context in ("iframe", "noembed", "noframes", "style", "xmp", "script"):
            self.tokens.raw = (context, False)
        elif context == "plaintext":
            self.tokens.raw = (context, False)
        if context == "template":
            self.templates.append(self.in_template)
        self.reset_mode()

    # -- the tree

    def insert(self, t: Token, ns: str = HTML) -> Node:
        attrs = _attrs(t, self.settings)
        if self.tokens.errors is not None:
            if len(attrs) < len(t.attrs):
                self.tokens.error(t.end, f"Dropped duplicate attribute(s) in tag [{t.name.lower()}]")
            if t.closed and ns == HTML and t.name.lower() not in T.VOID and (t.name.lower() in T.KNOWN):
                self.tokens.error(t.end, f"Tag [{t.name.lower()}] cannot be self closing; not a void tag")
        node = Node("element", t.name.lower(), attrs, ns=ns, raw_tag=self.settings.tag(t.name) if ns == HTML else t.name, start=t.start, end=t.end)
        node.closed, node.ranges = t.closed and (ns != HTML or node.tag not in T.KNOWN), t.ranges
        self.place(node)
        self.stack.append(node)
        if node.tag in T.FORM_LISTED and self.form is not None:
            node.form = self.form
        self.self_closed = node.tag if t.closed and ns == HTML else None
        return node

    def insert_void(self, t: Token) -> Node:
        node = self.insert(t)
        self.stack.pop()
        self.self_closed = None
        return node

    def place(self, node: Node) -> None:
        parent, at = self.spot()
        parent.append(node, at)
        if self.fresh is not None and node.kind == "element":
            self.fresh.append(node)

    def spot(self) -> tuple[Node, int | None]:
        top = self.stack[-1] if self.stack else self.doc
        if not (self.foster and top.tag in ("table", "tbody", "tfoot", "thead", "tr")):
            return top, None
        table = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k].tag == "table"), None)
        if table is None:
            return self.stack[0], None
        node = self.stack[table]
        return (node.parent, node.index()) if node.parent is not None else (self.stack[table - 1], None)

    def text(self, data: str, kind: str = "text", start: int = -1, end: int = -1) -> None:
        parent, at = self.spot()
        if kind == "text" and parent.tag in ("script", "style") and parent.ns == HTML:
            kind = "data"
        before = parent.children[(len(parent.children) if at is None else at) - 1] if (parent.children if at is None else at) else None
        if before is not None and before.kind == kind != "cdata":
            before.value += data
            before.end = end
        else:
            parent.append(Node(kind, f"#{kind}", value=data, start=start, end=end), at)

    def comment(self, t: Token, parent: Node | None = None) -> None:
        node = Node("comment", "#comment", value=t.name, start=t.start, end=t.end)
        parent.append(node) if parent is not None else self.place(node)

    def pop_to(self, *names: str) -> None:
        while self.stack and self.stack.pop().tag not in names:
            pass

    def clear_to(self, *names: str) -> None:
        while self.stack[-1].tag not in (*names, "html", "template"):
            self.stack.pop()

    def scope(self, names, extra=frozenset(), only=None) -> bool:
        names = (names,) if isinstance(names, str) else names
        for node in reversed(self.stack):
            if node.tag in names:
                return True
            if (node.tag in only) if only is not None else (node.tag in T.SCOPE or node.tag in extra):
                return False
        return False

    def button_scope(self, name: str) -> bool:
        return self.scope(name, {"button"})

    def table_scope(self, names) -> bool:
        return self.scope(names, only={"html", "table", "template"})

    def select_scope(self, name: str) -> bool:
        for node in reversed(self.stack):
            if node.tag == name:
                return True
            if node.tag not in ("optgroup", "option"):
                return False
        return False

    def imply_end(self, but: str = "", thorough: bool = False) -> None:
        while self.stack and self.stack[-1].tag != but and self.stack[-1].tag in (T.THOROUGH_END if thorough else T.IMPLIED_END):
            self.stack.pop()

    def close_p(self, t: Token) -> None:
        if self.button_scope("p"):
            self.close(Token("end", "p", start=t.end, end=t.end), "p", "p", but="p")

    def on_stack(self, name: str) -> bool:
        return any(n.tag == name for n in self.stack)

    # -- formatting elements

    def reconstruct(self) -> None:
        k = len(self.active) - 1
        if k < 0 or self.active[k] is None or any(n is self.active[k] for n in self.stack):
            return
        while k > 0 and self.active[k - 1] is not None and not any(n is self.active[k - 1] for n in self.stack):
            k -= 1
        for at in range(k, len(self.active)):
            new = self.active[at].copy()
            self.place(new)
            self.stack.append(new)
            self.active[at] = new

    def push_active(self, node: Node) -> None:
        same = 0
        for k in range(len(self.active) - 1, -1, -1):
            old = self.active[k]
            if old is None:
                break
            if old.tag == node.tag and sorted(old.attrs, key=str) == sorted(node.attrs, key=str):
                same += 1
                if same == 3:
                    del self.active[k]
                    break
        self.active.append(node)

    def clear_active(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def find_active(self, name: str) -> Node | None:
        for node in reversed(self.active):
            if node is None:
                return None
            if node.tag == name:
                return node
        return None

    @staticmethod
    def _drop(items: list, node: Node) -> None:
        items[:] = [n for n in items if n is not node]

    def adopt(self, name: str, t: Token) -> None:
        """The adoption agency: a formatting element is closed across the blocks that it was opened around."""
        if self.stack[-1].tag == name and not any(n is self.stack[-1] for n in self.active):
            self.stack.pop()
            return
        for _ in range(8):
            formatting = self.find_active(name)
            if formatting is None:
                self.any_end(name, t)
                return
            at = next((k for k, n in enumerate(self.stack) if n is formatting), None)
            if at is None:
                self.error(t, "InBody")
                self._drop(self.active, formatting)
                return
            if not self.scope(formatting.tag):
                self.error(t, "InBody")
                return
            if self.stack[-1] is not formatting:
                self.error(t, "InBody")
            furthest = next((k for k in range(at + 1, len(self.stack)) if self.stack[k].tag in T.SPECIAL and self.stack[k].ns == HTML), None)
            if furthest is None:
                del self.stack[at:]
                self._drop(self.active, formatting)
                return
            block, ancestor = self.stack[furthest], self.stack[at - 1]
            mark = next(k for k, n in enumerate(self.active) if n is formatting)
            last, k = block, furthest
            for inner in range(1, 1000):
                k -= 1
                node = self.stack[k]
                if node is formatting:
                    break
                own = next((j for j, n in enumerate(self.active) if n is node), None)
                if own is not None and inner > 3:
                    del self.active[own]
                    mark -= own < mark
                    own = None
                if own is None:
                    del self.stack[k]
                    continue
                new = node.copy()
                self.active[own] = self.stack[k] = new
                if last is block:
                    mark = own + 1
                new.append(last)
                last = new
            if ancestor.tag in ("table", "tbody", "tfoot", "thead", "tr"):
                last.remove()
                self.foster, before = True, self.foster
                kept, self.stack = self.stack, self.stack[:at]
                parent, spot = self.spot()
                self.stack, self.foster = kept, before
                parent.append(last, spot)
            else:
                ancestor.append(last)
            new = formatting.copy()
            for child in list(block.children):
                child.parent = new
            new.children, block.children = block.children, []
            block.append(new)
            self.active.insert(mark, new)
            self._drop(self.active, formatting)
            self._drop(self.stack, formatting)
            self.stack.insert(next(k for k, n in enumerate(self.stack) if n is block) + 1, new)

    def any_end(self, name: str, t: Token) -> None:
        if not self.on_stack(name):
            self.error(t, "InBody")
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == name:
                self.imply_end(name)
                self.expect(t, name)
                del self.stack[k:]
                return
            if self.stack[k].tag in T.SPECIAL and self.stack[k].ns == HTML:
                self.error(t, "InBody")
                return

    # -- modes

    def reset_mode(self) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            last, node = k == 0, self.stack[k]
            if last and self.context is not None:
                node = self.context
            found = {
                "select": self.in_select, "tr": self.in_row, "tbody": self.in_table_body, "thead": self.in_table_body, "tfoot": self.in_table_body,
                "caption": self.in_caption, "colgroup": self.in_colgroup, "table": self.in_table, "body": self.in_body, "frameset": self.in_frameset,
                "template": self.templates[-1] if self.templates else self.in_body,
            }.get(node.tag)
            if node.tag in ("td", "th") and not last:
                found = self.in_cell
            if node.tag == "head" and not last:
                found = self.in_head
            if node.tag == "html":
                found = self.before_head if self.head is None and self.context is None else self.in_body if self.context is not None else self.after_head
            if found or last:
                self.mode = found or self.in_body
                return

    def raw_text(self, t: Token, references: bool) -> None:
        self.insert(t)
        self.tokens.raw = None if t.closed else (t.name.lower(), references)
        self.back_to, self.mode = self.mode, self.in_text

    def initial(self, t: Token) -> None:
        if t.kind == "text" and T.is_blank(t.name):
            return
        if t.kind == "comment":
            self.comment(t, self.doc)
        elif t.kind == "doctype":
            self.doc.append(Node("doctype", "#doctype", [("name", t.name), ("publicId", t.attrs[0]), ("systemId", t.attrs[1]), ("pubSysKey", t.attrs[2])], start=t.start, end=t.end))
            self.doc.quirks = t.closed or t.name != "html" or t.attrs[0].lower() == "html"
            self.mode = self.before_html
        else:
            self.doc.quirks = True
            self.mode = self.before_html
            self.mode(t)

    def before_html(self, t: Token) -> None:
        if t.kind == "comment":
            self.comment(t, self.doc)
        elif t.kind == "doctype" or (t.kind == "end" and t.name.lower() not in ("head", "body", "html", "br")):
            self.error(t, "BeforeHtml")
        elif t.kind == "text" and T.is_blank(t.name):
            self.doc.append(Node("text", "#text", value=t.name))
        elif t.kind == "start" and t.name.lower() == "html":
            self.insert(t)
            self.mode = self.before_head
        else:
            self.insert(Token("start", "html"))
            self.mode = self.before_head
            self.mode(t)

    def before_head(self, t: Token) -> None:
        name = t.name.lower()
        if t.kind == "text" and T.is_blank(t.name):
            self.text(t.name)
        elif t.kind == "comment":
            self.comment(t)
        elif t.kind == "doctype" or (t.kind == "end" and name not in ("head", "body", "html", "br")):
            self.error(t, "BeforeHead")
        elif t.kind == "start" and name == "html":
            self.in_body(t)
        elif t.kind == "start" and name == "head":
            self.head = self.insert(t)
            self.mode = self.in_head
        else:
            self.head = self.insert(Token("start", "head"))
            self.mode = self.in_head
            self.mode(t)

    def in_head(self, t: Token) -> None:
        name = t.name.lower() if t.kind in ("start", "end") else ""
        if t.kind == "text" and T.is_blank(t.name):
            self.text(t.name)
        elif t.kind == "comment":
            self.comment(t)
        elif t.kind == "doctype":
            self.error(t, "InHead")
        elif t.kind == "start" and name == "html":
            self.in_body(t)
        elif t.kind == "start" and name in ("base", "basefont", "bgsound", "command", "link", "meta"):
            node = self.insert_void(t)
            if name == "base" and not self.base_set and node.attr("href"):
                from tagweave.markup.urls import resolve

                if found := resolve(self.doc.base_uri, node.attr("href")):
                    self.doc.base_uri, self.base_set = found, True
        elif t.kind == "start" and name == "title":
            self.raw_text(t, True)
        elif t.kind == "start" and name in ("noframes", "style", "script"):
            self.raw_text(t, False)
        elif t.kind == "start" and name == "noscript":
            self.insert(t)
            self.mode = self.in_head_noscript
        elif t.kind == "start" and name == "template":
            self.insert(t)
            self.active.append(None)
            self.frames_ok = False
            self.templates.append(self.in_template)
            self.mode = self.in_template
        elif t.kind == "end" and name == "template":
            if self.on_stack("template"):
                self.imply_end(thorough=True)
                self.expect(t, "template", "InHead")
                self.pop_to("template")
                self.clear_active()
                self.templates.pop()
                self.reset_mode()
            else:
                self.error(t, "InHead")
        elif t.kind == "end" and name == "head":
            self.stack.pop()
            self.mode = self.after_head
        elif (t.kind == "start" and name == "head") or (t.kind == "end" and name not in ("body", "html", "br")):
            self.error(t, "InHead")
        else:
            self.stack.pop()
            self.mode = self.after_head
            self.mode(t)

    def in_head_noscript(self, t: Token) -> None:
        name = t.name.lower() if t.kind in ("start", "end") else ""
        if t.kind == "end" and name == "noscript":
            self.stack.pop()
            self.mode = self.in_head
        elif t.kind == "comment" or (t.kind == "text" and T.is_blank(t.name)) or (t.kind == "start" and name in ("basefont", "bgsound", "link", "meta", "noframes", "style")):
            self.in_head(t)
        elif t.kind == "eof":
            self.stack.pop()
            self.mode = self.in_head
            self.mode(t)
        elif t.kind == "doctype" or t.kind == "start" and name in ("head", "noscript") or t.kind == "end" and name != "br":
            self.error(t, "InHeadNoscript")
            if t.kind == "end":
                self.text(self.tokens.text[t.start : t.end])
        elif t.kind == "text":
            self.error(t, "InHeadNoscript")
            self.text(t.name)
        elif t.kind in ("start", "end"):
            self.error(t, "InHeadNoscript")
            self.text(self.tokens.text[t.start : t.end])

    def after_head(self, t: Token) -> None:
        name = t.name.lower() if t.kind in ("start", "end") else ""
        if t.kind == "text" and T.is_blank(t.name):
            self.text(t.name)
        elif t.kind == "comment":
            self.comment(t)
        elif t.kind == "doctype":
            self.error(t, "AfterHead")
        elif t.kind == "start" and name == "html":
            self.in_body(t)
        elif t.kind == "start" and name == "body":
            self.insert(t)
            self.frames_ok = False
            self.mode = self.in_body
        elif t.kind == "start" and name == "frameset":
            self.insert(t)
            self.mode = self.in_frameset
        elif t.kind == "start" and name in ("base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "title"):
            self.error(t, "AfterHead")
            self.stack.append(self.head)
            self.in_head(t)
            self._drop(self.stack, self.head)
        elif (t.kind == "start" and name == "head") or (t.kind == "end" and name not in ("body", "html", "br", "template")):
            self.error(t, "AfterHead")
        elif t.kind == "end" and name == "template":
            self.in_head(t)
        else:
            self.insert(Token("start", "body"))
            self.mode = self.in_body
            self.mode(t)

    def in_text(self, t: Token) -> None:
        if t.kind == "text":
            self.text(t.name, start=t.start, end=t.end)
            return
        if t.kind == "eof":
            self.error(t, "Text")
        self.tokens.raw = None
        self.stack.pop()
        self.mode = self.back_to
        if t.kind != "end":
            self.mode(t)

    def in_body(self, t: Token) -> None:
        if t.kind == "text":
            data = t.name.replace("\0", "")
            if data != t.name:
                self.error(t, "InBody")
            if data:
                self.reconstruct()
                self.text(data, start=t.start, end=t.end)
                if not T.is_blank(data):
                    self.frames_ok = False
        elif t.kind == "comment":
            self.comment(t)
        elif t.kind == "cdata":
            self.text(t.name, "cdata")
        elif t.kind == "start":
            self.body_start(t, t.name.lower())
        elif t.kind == "end":
            self.body_end(t, t.name.lower())
        elif t.kind == "doctype":
            self.error(t, "InBody")
        elif t.kind == "eof" and self.templates:
            self.in_template(t)
        elif t.kind == "eof":
            self.left_open(t)

    def body_start(self, t: Token, name: str) -> None:
        if name == "a":
            if (old := self.find_active("a")) is not None:
                self.error(t, "InBody")
                self.adopt("a", t)
                self._drop(self.active, old)
                self._drop(self.stack, old)
            self.reconstruct()
            self.push_active(self.insert(t))
        elif name == "span":
            self.reconstruct()
            self.insert(t)
        elif name in T.FORMATTING:
            self.reconstruct()
            self.push_active(self.insert(t))
        elif name == "nobr":
            self.reconstruct()
            if self.scope("nobr"):
                self.error(t, "InBody")
                self.adopt("nobr", t)
                self.reconstruct()
            self.push_active(self.insert(t))
        elif name in T.P_CLOSERS:
            self.close_p(t)
            self.insert(t)
        elif name in T.HEADINGS:
            self.close_p(t)
            if self.stack[-1].tag in T.HEADINGS:
                self.error(t, "InBody")
                self.stack.pop()
            self.insert(t)
        elif name in ("li", "dd", "dt"):
            self.frames_ok = False
            kinds = ("li",) if name == "li" else ("dd", "dt")
            for node in reversed(self.stack):
                if node.tag in kinds:
                    self.imply_end(node.tag)
                    self.pop_to(node.tag)
                    break
                if node.tag in T.SPECIAL and node.tag not in ("address", "div", "p"):
                    break
            self.close_p(t)
            self.insert(t)
        elif name in ("area", "br", "embed", "img", "keygen", "wbr"):
            self.reconstruct()
            self.insert_void(t)
            self.frames_ok = False
        elif name == "image":
            self.body_start(t._replace(name="img"), "img") if not self.on_stack("svg") else self.insert(t)
        elif name == "input":
            self.reconstruct()
            node = self.insert_void(t)
            if (node.attr("type") or "").lower() != "hidden":
                self.frames_ok = False
        elif name in ("param", "source", "track"):
            self.insert_void(t)
        elif name == "hr":
            self.close_p(t)
            self.insert_void(t)
            self.frames_ok = False
        elif name in ("pre", "listing"):
            self.close_p(t)
            self.insert(t)
            self.skip_newline, self.frames_ok = True, False
        elif name == "form":
            if self.form is None or self.on_stack("template"):
                self.close_p(t)
                node = self.insert(t)
                if not self.on_stack("template"):
                    self.form = node
            else:
                self.error(t, "InBody")
        elif name == "table":
            if not self.doc.quirks:
                self.close_p(t)
            self.insert(t)
            self.frames_ok, self.mode = False, self.in_table
        elif name == "button":
            if self.scope("button"):
                self.error(t, "InBody")
                self.imply_end()
                self.pop_to("button")
            self.reconstruct()
            self.insert(t)
            self.frames_ok = False
        elif name in ("base", "basefont", "bgsound", "command", "link", "meta", "noframes", "script", "style", "template", "title"):
            self.in_head(t)
        elif name == "html":
            self.error(t, "InBody")
            if not self.on_stack("template") and self.stack:
                self._merge(self.stack[0], t)
        elif name == "body":
            self.error(t, "InBody")
            if len(self.stack) > 1 and self.stack[1].tag == "body" and not self.on_stack("template"):
                self.frames_ok = False
                self._merge(self.stack[1], t)
        elif name == "frameset":
            self.error(t, "InBody")
            if self.frames_ok and len(self.stack) > 1 and self.stack[1].tag == "body":
                self.stack[1].remove()
                del self.stack[1:]
                self.insert(t)
                self.mode = self.in_frameset
        elif name == "isindex":
            self.error(t, "InBody")
            if self.form is None:
                prompt = next((v for k, v in t.attrs if k.lower() == "prompt"), None) or "This is a searchable index. Enter search keywords: "
                for part in (Token("start", "form", tuple((k, v) for k, v in t.attrs if k.lower() == "action")), Token("start", "hr"), Token("start", "label"), Token("text", prompt)):
                    self.process(part)
                kept = tuple((k, v) for k, v in t.attrs if k.lower() not in ("name", "action", "prompt"))
                for part in (Token("start", "input", (*kept, ("name", "isindex"))), Token("end", "label"), Token("start", "hr"), Token("end", "form")):
                    self.process(part)
        elif name == "textarea":
            self.raw_text(t, True)
            self.frames_ok = False
        elif name in ("xmp", "iframe", "noembed"):
            if name == "xmp":
                self.close_p(t)
                self.reconstruct()
            self.frames_ok = False
            self.raw_text(t, False)
        elif name == "plaintext":
            self.close_p(t)
            self.insert(t)
            self.tokens.raw = None if t.closed else ("plaintext", False)
        elif name == "select":
            self.reconstruct()
            self.insert(t)
            self.frames_ok = False
            self.mode = self.in_select_table if self.mode in (self.in_table, self.in_caption, self.in_table_body, self.in_row, self.in_cell) else self.in_select
        elif name in ("optgroup", "option"):
            if self.stack[-1].tag == "option":
                self.stack.pop()
            self.reconstruct()
            self.insert(t)
        elif name in ("rb", "rtc", "rp", "rt"):
            if self.scope("ruby"):
                self.imply_end("rtc" if name in ("rp", "rt") else "")
                if self.stack[-1].tag not in (("rtc", "ruby") if name in ("rp", "rt") else ("ruby",)):
                    self.error(t, "InBody")
            self.insert(t)
        elif name in ("math", "svg"):
            self.reconstruct()
            self.insert(t, SVG if name == "svg" else MATHML)
            if t.closed:
                self.stack.pop()
        elif name in ("applet", "marquee", "object"):
            self.reconstruct()
            self.insert(t)
            self.active.append(None)
            self.frames_ok = False
        elif name in T.TABLE_PARTS or name in ("frame", "head"):
            self.error(t, "InBody")
        elif name == "noscript":
            self.reconstruct()
            self.insert(t)
        else:
            if name in T.KNOWN:  # tags without rules of their own don't reopen formatting
                self.reconstruct()
            self.insert(t)

    def _merge(self, node: Node, t: Token) -> None:
        have = {k for k, _ in node.attrs}
        node.attrs += [(k, v) for k, v in _attrs(t, self.settings) if k not in have]

    def body_end(self, t: Token, name: str) -> None:
        if name == "p":
            if not self.button_scope("p"):
                self.error(t, "InBody")
                self.insert(Token("start", "p"))
            self.close(t, "p", "p", but="p")
        elif name == "a" or name == "nobr" or name in T.FORMATTING:
            self.adopt(name, t)
        elif name in ("body", "html"):
            if self.scope("body"):
                self.left_open(t)
                self.mode = self.after_body
                if name == "html":
                    self.mode(t)
            else:
                self.error(t, "InBody")
        elif name == "form":
            if self.on_stack("template"):
                if self.scope("form"):
                    self.close(t, "form", "form")
                else:
                    self.error(t, "InBody")
                return
            node, self.form = self.form, None
            if node is not None and self.scope("form"):
                self.imply_end()
                self.expect(t, "form")
                self._drop(self.stack, node)
            else:
                self.error(t, "InBody")
        elif name == "br":
            self.error(t, "InBody")
            self.body_start(Token("start", "br"), "br")
        elif name == "template":
            self.in_head(t)
        elif name == "li":
            self.close(t, name, name, but=name) if self.scope("li", {"ol", "ul"}) else self.error(t, "InBody")
        elif name in ("dd", "dt"):
            self.close(t, name, name, but=name) if self.scope(name) else self.error(t, "InBody")
        elif name in T.HEADINGS:
            self.close(t, name, *T.HEADINGS, but=name) if self.scope(T.HEADINGS) else self.error(t, "InBody")
        elif name in ("applet", "marquee", "object"):
            if self.scope(name):
                self.close(t, name, name)
                self.clear_active()
            else:
                self.error(t, "InBody")
        elif name in T.P_CLOSERS or name in ("button", "listing", "pre"):
            self.close(t, name, name) if self.scope(name) else self.error(t, "InBody")
        else:
            self.any_end(name, t)

    def close(self, t: Token, name: str, *until: str, but: str = "") -> None:
        """Implied ends, then up to the element that the end tag is for."""
        self.imply_end(but)
        self.expect(t, name)
        self.pop_to(*until)

    def fostered(self, t: Token) -> None:
        self.error(t, "InTable")
        self.foster = True
        self.in_body(t)
        self.foster = False

    def in_table(self, t: Token) -> None:
        name = t.name.lower() if t.kind in ("start", "end") else ""
        if t.kind == "text":
            if T.is_blank(t.name):
                self.text(t.name, start=t.start, end=t.end)
            else:
                self.fostered(t)
        elif t.kind == "comment":
            self.comment(t)
        elif t.kind == "doctype":
            self.error(t, "InTable")
        elif t.kind == "start" and name == "caption":
            self.clear_to("table")
            self.active.append(None)
            self.insert(t)
            self.mode = self.in_caption
        elif t.kind == "start" and name == "colgroup":
            self.clear_to("table")
            self.insert(t)
            self.mode = self.in_colgroup
        elif t.kind == "start" and name == "col":
            self.clear_to("table")
            self.insert(Token("start", "colgroup"))
            self.mode = self.in_colgroup
            self.mode(t)
        elif t.kind == "start" and name in ("tbody", "tfoot", "thead"):
            self.clear_to("table")
            self.insert(t)
            self.mode = self.in_table_body
        elif t.kind == "start" and name in ("td", "th", "tr"):
            self.clear_to("table")
            self.insert(Token("start", "tbody"))
            self.mode = self.in_table_body
            self.mode(t)
        elif t.kind == "start" and name == "table":
            self.error(t, "InTable")
            if self.table_scope("table"):
                self.pop_to("table")
                self.reset_mode()
                self.process(t)
        elif t.kind == "end" and name == "table":
            if self.table_scope("table"):
                self.pop_to("table")
                self.reset_mode()
            else:
                self.error(t, "InTable")
        elif t.kind == "end" and name in ("body", "html", *T.TABLE_PARTS):
            self.error(t, "InTable")
        elif name in ("style", "script", "template"):
            self.in_head(t)
        elif t.kind == "start" and name == "input" and next((v or "" for k, v in t.attrs if k.lower() == "type"), "").lower() == "hidden":
            self.insert_void(t)
        elif t.kind == "start" and name == "form":
            self.error(t, "InTable")
            if self.form is None and not self.on_stack("template"):
                self.form = self.insert(t)
                self.stack.pop()
        elif t.kind == "eof":
            self.in_body(t)
        else:
            self.fostered(t)

    def in_caption(self, t: Token) -> None:
        name = t.name.lower() if t.kind in ("start", "end") else ""
        closes = (t.kind == "start" and name in T.TABLE_PARTS) or (t.kind == "end" and name in ("caption", "table"))
        if closes:
            if self.table_scope("caption"):
                self.imply_end()
                if t.kind == "start" or name == "table":
                    self.error(t, "InCaption")
                else:
                    self.expect(t, "caption", "InCaption")
                self.pop_to("caption")
                self.clear_active()
                self.mode = self.in_table
                if not (t.kind == "end" and name == "caption"):
                    self.mode(t)
            else:
                self.error(t, "InCaption")
        elif t.kind == "end" and name in ("body", "html", *T.TABLE_PARTS):
            self.error(t, "InCaption")
        else:
            self.in_body(t)

    def in_colgroup(self, t: Token) -> None:
        name = t.name.lower() if t.kind in ("start", "end") else ""
        if t.kind == "text" and T.is_blank(t.name):
            self.text(t.name)
        elif t.kind == "comment":
            self.comment(t)
        elif t.kind == "start" and name == "col":
            self.insert_void(t)
        elif name == "template":
            self.in_head(t)
        elif t.kind == "start" and name == "html":
            self.in_body(t)
        elif t.kind == "end" and name == "col" or t.kind == "doctype":
            self.error(t, "InColumnGroup")
        elif self.stack[-1].tag == "colgroup":
            self.stack.pop()
            self.mode = self.in_table
            if not (t.kind == "end" and name == "colgroup"):
                self.mode(t)
        elif t.kind != "eof":
            self.error(t, "InColumnGroup")

    def in_table_body(self, t: Token) -> None:
        name = t.name.lower() if t.kind in ("start", "end") else ""
        sections = ("tbody", "tfoot", "thead")
        if t.kind == "start" and name == "tr":
            self.clear_to(*sections)
            self.insert(t)
            self.mode = self.in_row
        elif t.kind == "start" and name in ("td", "th"):
            self.error(t, "InTableBody")
            self.clear_to(*sections)
            self.insert(Token("start", "tr"))
            self.mode = self.in_row
            self.mode(t)
        elif t.kind == "end" and name in sections:
            if self.table_scope(name):
                self.clear_to(*sections)
                self.stack.pop()
                self.mode = self.in_table
            else:
                self.error(t, "InTableBody")
        elif (t.kind == "start" and name in ("caption", "col", "colgroup", *sections)) or (t.kind == "end" and name == "table"):
            if self.table_scope(sections):
                self.clear_to(*sections)
                self.stack.pop()
                self.mode = self.in_table
                self.mode(t)
            else:
                self.error(t, "InTableBody")
        elif t.kind == "end" and name in ("body", "caption", "col", "colgroup", "html", "td", "th", "tr"):
            self.error(t, "InTableBody")
        else:
            self.in_table(t)

    def in_row(self, t: Token) -> None:
        name = t.name.lower() if t.kind in ("start", "end") else ""
        if t.kind == "start" and name in ("td", "th"):
            self.clear_to("tr")
            self.insert(t)
            self.active.append(None)
            self.mode = self.in_cell
        elif (t.kind == "end" and name in ("tr", "table", "tbody", "tfoot", "thead")) or (t.kind == "start" and name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead", "tr")):
            if self.table_scope("tr") and (t.kind == "start" or name in ("tr", "table") or self.table_scope(name)):
                self.clear_to("tr")
                self.stack.pop()
                self.mode = self.in_table_body
                if not (t.kind == "end" and name == "tr"):
                    self.mode(t)
            else:
                self.error(t, "InRow")
        elif t.kind == "end" and name in ("body", "caption", "col", "colgroup", "html", "td", "th"):
            self.error(t, "InRow")
        else:
            self.in_table(t)

    def in_cell(self, t: Token) -> None:
        name = t.name.lower() if t.kind in ("start", "end") else ""
        if t.kind == "end" and name in ("td", "th"):
            if self.table_scope(name):
                self.imply_end()
                self.expect(t, name, "InCell")
                self.pop_to(name)
                self.clear_active()
                self.mode = self.in_row
            else:
                self.error(t, "InCell")
                self.mode = self.in_row
        elif (t.kind == "start" and name in T.TABLE_PARTS) or (t.kind == "end" and name in ("table", "tbody", "tfoot", "thead", "tr") and self.table_scope(name)):
            if self.table_scope(("td", "th")):
                self.imply_end()
                self.pop_to("td", "th")
                self.clear_active()
                self.mode = self.in_row
                self.mode(t)
            else:
                self.error(t, "InCell")
        elif t.kind == "end" and name in ("body", "caption", "col", "colgroup", "html", "table", "tbody", "tfoot", "thead", "tr"):
            self.error(t, "InCell")
        else:
            self.in_body(t)

    def in_select(self, t: Token) -> None:
        name = t.name.lower() if t.kind in ("start", "end") else ""
        top = self.stack[-1].tag
        if t.kind == "text":
            if "\0" in t.name:
                self.error(t, "InSelect")
            if data := t.name.replace("\0", ""):
                self.text(data, start=t.start, end=t.end)
        elif t.kind == "comment":
            self.comment(t)
        elif t.kind == "start" and name == "option":
            if top == "option":
                self.stack.pop()
            self.insert(t)
        elif t.kind == "start" and name == "optgroup":
            if top == "option":
                self.stack.pop()
            if self.stack[-1].tag == "optgroup":
                self.stack.pop()
            self.insert(t)
        elif t.kind == "end" and name == "optgroup":
            if top == "option" and len(self.stack) > 1 and self.stack[-2].tag == "optgroup":
                self.stack.pop()
            if self.stack[-1].tag == "optgroup":
                self.stack.pop()
            else:
                self.error(t, "InSelect")
        elif t.kind == "end" and name == "option":
            if top == "option":
                self.stack.pop()
            else:
                self.error(t, "InSelect")
        elif name == "select" or (t.kind == "start" and name in ("input", "keygen", "textarea")):
            if t.kind == "start":
                self.error(t, "InSelect")
            if self.select_scope("select"):
                self.pop_to("select")
                self.reset_mode()
                if t.kind == "start" and name != "select":
                    self.mode(t)
            elif t.kind == "end":
                self.error(t, "InSelect")
        elif name in ("script", "template"):
            self.in_head(t)
        elif t.kind == "start" and name == "html":
            self.in_body(t)
        elif t.kind != "eof" or top != "html":
            self.error(t, "InSelect")

    def in_select_table(self, t: Token) -> None:
        name = t.name.lower() if t.kind in ("start", "end") else ""
        if name in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th"):
            self.error(t, "InSelectInTable")
            if t.kind == "start" or self.table_scope(name):
                self.pop_to("select")
                self.reset_mode()
                self.mode(t)
        else:
            self.in_select(t)

    def in_template(self, t: Token) -> None:
        name = t.name.lower() if t.kind in ("start", "end") else ""
        if t.kind in ("text", "comment", "cdata"):
            self.in_body(t)
        elif t.kind == "start" and name in ("base", "basefont", "bgsound", "link", "meta", "noframes", "script", "style", "template", "title") or (t.kind == "end" and name == "template"):
            self.in_head(t)
        elif t.kind == "start":
            mode = {"col": self.in_colgroup, "tr": self.in_table_body, "td": self.in_row, "th": self.in_row}.get(name, self.in_table if name in T.TABLE_PARTS else self.in_body)
            self.templates[-1] = self.mode = mode
            self.mode(t)
        elif t.kind in ("end", "doctype"):
            self.error(t, "InTemplate")
        elif t.kind == "eof" and self.on_stack("template"):
            self.error(t, "InTemplate")
            self.pop_to("template")
            self.clear_active()
            self.templates.pop()
            self.reset_mode()
            self.mode(t)

    def after_body(self, t: Token) -> None:
        if t.kind == "text" and T.is_blank(t.name):
            self.stack[0].append(Node("text", "#text", value=t.name))
        elif t.kind == "comment":
            self.comment(t, self.stack[0])
        elif t.kind == "end" and t.name.lower() == "html":
            if self.context is None:
                self.mode = self.after_after_body
            else:
                self.error(t, "AfterBody")
        elif t.kind == "doctype":
            self.error(t, "AfterBody")
        elif t.kind != "eof":
            self.error(t, "AfterBody")
            self.mode = self.in_body
            self.mode(t)

    def after_after_body(self, t: Token) -> None:
        if t.kind == "comment":
            self.comment(t, self.doc)
        elif t.kind == "text" and T.is_blank(t.name):
            self.doc.append(Node("text", "#text", value=t.name))
        elif t.kind not in ("eof", "doctype"):
            self.error(t, "AfterAfterBody")
            self.mode = self.in_body
            self.mode(t)

    def in_frameset(self, t: Token) -> None:
        name = t.name.lower() if t.kind in ("start", "end") else ""
        if t.kind == "text":
            if blank := "".join(c for c in t.name if c in T.SPACE):
                self.text(blank)
        elif t.kind == "comment":
            self.comment(t)
        elif t.kind == "start" and name == "frameset":
            self.insert(t)
        elif t.kind == "start" and name == "frame":
            self.insert_void(t)
        elif t.kind == "end" and name == "frameset" and len(self.stack) > 1:
            self.stack.pop()
            if self.stack[-1].tag != "frameset":
                self.mode = self.after_frameset
        elif t.kind == "start" and name == "noframes":
            self.in_head(t)
        elif t.kind != "eof" or self.stack[-1].tag != "html":
            self.error(t, "InFrameset")

    def after_frameset(self, t: Token) -> None:
        if t.kind == "text":
            if blank := "".join(c for c in t.name if c in T.SPACE):
                self.text(blank)
        elif t.kind == "comment":
            self.comment(t)
        elif t.kind == "start" and t.name.lower() == "noframes":
            self.in_head(t)
        elif t.kind == "end" and t.name.lower() == "html":
            self.mode = self.after_after_frameset
        elif t.kind != "eof":
            self.error(t, "AfterFrameset")

    def after_after_frameset(self, t: Token) -> None:
        if t.kind == "comment":
            self.comment(t, self.doc)
        elif t.kind == "text" and T.is_blank(t.name):
            self.doc.append(Node("text", "#text", value=t.name))
        elif t.kind == "start" and t.name.lower() == "noframes":
            self.in_head(t)
        elif t.kind != "eof":
            self.error(t, "AfterAfterFrameset")

    def in_foreign(self, t: Token) -> None:
        name = t.name.lower() if t.kind in ("start", "end") else ""
        if t.kind == "text":
            self.text(t.name.replace("\0", "�"), start=t.start, end=t.end)
        elif t.kind == "cdata":
            self.text(t.name, "cdata", t.start, t.end)
        elif t.kind == "comment":
            self.comment(t)
        elif t.kind == "start" and (name in T.FOREIGN_BREAKOUT or (name == "font" and any(k.lower() in ("color", "face", "size") for k, _ in t.attrs))):
            self.error(t, "ForeignContent")
            while len(self.stack) > 1 and self.stack[-1].ns != HTML:
                self.stack.pop()
            self.mode(t)
        elif t.kind == "start":
            self.insert(t, self.stack[-1].ns)
            if t.closed:
                self.stack.pop()
        elif t.kind == "end":
            if self.stack[-1].tag != name:
                self.error(t, "ForeignContent")
            for k in range(len(self.stack) - 1, 0, -1):
                node = self.stack[k]
                if node.ns == HTML:
                    self.mode(t)
                    return
                if node.tag == name:
                    del self.stack[k:]
                    return


def parse(html: str, base_uri: str = "", errors: list | None = None, settings: Settings = FOLD) -> Document:
    return HtmlBuilder(html or "", base_uri, errors=errors, settings=settings).build()


def parse_xml(xml: str, base_uri: str = "", errors: list | None = None, settings: Settings = KEEP) -> Document:
    return XmlBuilder(xml or "", base_uri, errors, settings).build()


def parse_fragment(html: str, context: str = "body", base_uri: str = "", errors: list | None = None, settings: Settings = FOLD) -> list[Node]:
    """Nodes of a fragment as children of an element ``context`` would be."""
    doc = HtmlBuilder(html or "", base_uri, context, errors, settings).build()
    nodes = list(doc.children[0].children)
    for n in nodes:
        n.parent = None
    return nodes


def parse_xml_fragment(xml: str, base_uri: str = "", errors: list | None = None) -> list[Node]:
    nodes = list(parse_xml(xml, base_uri, errors).children)
    for n in nodes:
        n.parent = None
    return nodes


def shell(base_uri: str = "") -> Document:
    """A document with nothing in its head and body."""
    doc = Document(base_uri)
    root = doc.append(Node("element", "html"))
    root.append(Node("element", "head"))
    root.append(Node("element", "body"))
    return doc


def parse_body_fragment(html: str, base_uri: str = "", errors: list | None = None) -> Document:
    doc = shell(base_uri)
    for n in parse_fragment(html, "body", base_uri, errors):
        doc.children[0].children[1].append(n)
    return doc

"""Small helpers that run inside tasks: pick named texts out of HTML, search JSON trees.

Everything that decides a snapshot is a Spark expression over what these return.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# an opening tag ends an open one of the same list without a closing tag
IMPLIED = {"li": {"li"}, "p": {"p"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}}

_PART = re.compile(
    r"#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|:not\(\.(?P<no>[\w-]+)\)"
    r"|\[(?P<attr>[\w-]+)(?:(?P<op>[\^*]?=)[\"']?(?P<val>[^\"'\]]*)[\"']?)?\]|(?P<tag>[A-Za-z][\w]*)"
)


class Page(HTMLParser):
    """A page as a flat list of elements with their ancestors and text.

    The text below an element is one run of the page's text pieces, so it is kept as
    the run's bounds.
    """

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.parents: list[int] = []
        self.pieces: list[str] = []
        self.runs: list[list[int]] = []
        self.open: list[int] = []
        self.feed(html)
        self.close()
        self._shut(0)

    def _shut(self, depth: int) -> None:
        for e in self.open[depth:]:
            self.runs[e][1] = len(self.pieces)
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes = IMPLIED.get(tag)
        if closes and self.open and self.tags[self.open[-1]] in closes:
            self._shut(len(self.open) - 1)
        self.tags.append(tag)
        self.attrs.append({k: v or "" for k, v in reversed(attrs)})
        self.parents.append(self.open[-1] if self.open else -1)
        self.runs.append([len(self.pieces), len(self.pieces)])
        if tag not in VOID:
            self.open.append(len(self.tags) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.tags[self.open[depth]] == tag:
                self._shut(depth)
                return

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)

    def above(self, i: int) -> Iterator[int]:
        while i >= 0:
            yield i
            i = self.parents[i]

    def text(self, i: int, without: str | None = None) -> str:
        """All text below an element, leaving out elements of one class."""
        start, end = self.runs[i]
        if not without:
            return "".join(self.pieces[start:end])
        hidden: set[int] = set()
        for e in range(i + 1, len(self.tags)):
            if self.runs[e][0] >= end:
                break
            if without in self.attrs[e].get("class", "").split():
                hidden.update(range(*self.runs[e]))
        return "".join(self.pieces[k] for k in range(start, end) if k not in hidden)

    def fits(self, i: int, compound: list[dict[str, str | None]]) -> bool:
        attrs = self.attrs[i]
        classes = attrs.get("class", "").split()
        for p in compound:
            if p["tag"] and p["tag"].lower() != self.tags[i]:
                return False
            if p["id"] and attrs.get("id") != p["id"]:
                return False
            if p["cls"] and p["cls"] not in classes:
                return False
            if p["no"] and p["no"] in classes:
                return False
            if p["attr"]:
                value = attrs.get(p["attr"].lower())
                wanted = p["val"]
                if value is None or (
                    p["op"]
                    and not {
                        "=": value == wanted,
                        "^=": value.startswith(wanted),
                        "*=": wanted in value,
                    }[p["op"]]
                ):
                    return False
        return True

    def select(self, chains: list[list[list[dict[str, str | None]]]]) -> Iterator[int]:
        """Elements matching any chain of compounds joined by descent, in page order."""
        for i in range(len(self.tags)):
            for chain in chains:
                if not self.fits(i, chain[-1]):
                    continue
                rest = len(chain) - 2
                for e in self.above(self.parents[i]):
                    if rest >= 0 and self.fits(e, chain[rest]):
                        rest -= 1
                if rest < 0:
                    yield i
                    break


def compile_selector(text: str) -> list[list[list[dict[str, str | None]]]]:
    """'a .b, #c' -> alternatives, each a list of compounds from outer to inner."""
    return [
        [[m.groupdict() for m in _PART.finditer(word)] for word in alternative.split()]
        for alternative in text.split(",")
    ]


def pick(html: str, wanted: list[dict]) -> list[dict]:
    """Values of every wanted selector: {key, pos, scope, value} in page order.

    A want has key and selector, and optionally attr (an attribute instead of text),
    first (only the first element), where (a pattern the text must match), without
    (class left out of the text) and scope (selector of the element it belongs to).
    """
    page = Page(html)
    out = []
    for want in wanted:
        scopes = set(page.select(want["scope"])) if want.get("scope") else set()
        for i in page.select(want["css"]):
            attr = want.get("attr")
            value = page.attrs[i].get(attr) if attr else page.text(i, want.get("without"))
            if value is None or (want.get("where") and not want["where"].search(value)):
                continue
            scope = next((e for e in page.above(i) if e in scopes), -1)
            out.append({"key": want["key"], "pos": i, "scope": scope, "value": value})
            if want.get("first"):
                break
    return out


def nodes(tree: object) -> Iterator[dict]:
    """Every JSON object of a tree, outer before inner, in document order."""
    stack = [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            yield node
            stack.extend(reversed(list(node.values())))
        elif isinstance(node, list):
            stack.extend(reversed(node))


def first_text(tree: object, field: str, pattern: str) -> str | None:
    """The first string under a field name that matches a pattern."""
    for node in nodes(tree):
        value = node.get(field)
        if isinstance(value, str) and re.search(pattern, value):
            return value
    return None


def state_offers(html: str) -> list[dict]:
    """Offer objects of the page's embedded state: title, kind, subtitle, amount, EMI flag."""
    at = html.find("window.__INITIAL_STATE__")
    start = html.find("{", at) if at >= 0 else -1
    if start < 0:
        return []
    try:
        state, _ = json.JSONDecoder().raw_decode(html, start)
    except ValueError:
        return []
    out = []
    for node in nodes(state):
        if node.get("type") == "NepOffers" and node.get("offerTitle"):
            kind = node.get("offerType")
            out.append(
                {
                    "title": str(node["offerTitle"]),
                    "kind": kind if isinstance(kind, str) else None,
                    "sub": first_text(node.get("offerSubTitleRC"), "contentValue", r"\S"),
                    "amount": first_text(node, "metaInfoLabelValue", "[₹%]"),
                    "emi": "tenure" in node,
                }
            )
    return out


def response_facts(text: str) -> dict:
    """What only a search of a pricing response finds: place, seller, any sold-out flag."""
    out = {"parsed": False, "pincode": None, "city": None, "error_code": None,
           "sold_out": False, "seller_id": None, "seller_name": None}
    try:
        root = json.loads(text)
    except (TypeError, ValueError):
        return out
    out["parsed"] = True

    def words(value: object) -> str | None:
        return value if isinstance(value, str) else None

    for node in nodes(root):
        code = node.get("pincode")
        beside = any(k in node for k in ("sellerCount", "singleSeller", "city"))
        if code is not None and beside and re.fullmatch(r"[0-9]{6}", str(code)):
            out.update(pincode=str(code), city=words(node.get("city")), error_code=words(node.get("errorCode")))
            break
    context = root
    for step in ("RESPONSE", "pageData", "pageContext"):
        context = context.get(step) if isinstance(context, dict) else None
    for node in nodes(context):
        status = node.get("availabilityStatus")
        if isinstance(status, str) and re.search(
            "OUT_OF_STOCK|SOLD_OUT|UNSERVICEABLE|COMING_SOON", status, re.I
        ):
            out["sold_out"] = True
            break
    for node in nodes(context):
        if words(node.get("sellerId")) is not None or words(node.get("sellerName")) is not None:
            out.update(seller_id=words(node.get("sellerId")), seller_name=words(node.get("sellerName")))
            break
    return out

"""Structural page metrics: one tolerant pass over the markup per page, run Arrow batch by Arrow batch."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from webloom.session import ship

#: Void elements, names that form fields should have, and words of checks on robots.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FIELD_NAMES = frozenset(
    "email firstName first_name lastName last_name fullName full_name phone telephone postcode postal_code address1 street_address address2 city county state country "
    "country_code cardNumber card_number expiryDate expiry cvv cvc password username dateOfBirth date_of_birth company company_name quantity".split()
)
GENERIC_ANCHORS = frozenset(("click here", "read more", "learn more"))
ROBOT_WORDS = ("captcha", "verify you are human", "security check", "bot protection")
STATES = ("data-state", "data-authenticated", "data-validation-state", "data-error-code", "data-loading")
CELL_DATA = ("data-price", "data-currency", "data-quantity", "data-in-stock", "data-product-id", "data-rating")
HINTS = ("preload", "prefetch", "dns-prefetch", "preconnect")
LANDMARKS = frozenset("nav header footer aside main article section form".split())
FONT_FACE, FONT_URL = re.compile(r"@font-face\s*\{[^}]*\}", re.I), re.compile(r"url\(\s*[\"']?([^\"')]+)")
PRELOAD_TYPES = {"script": "javascript", "style": "css", "image": "image", "font": "font", "video": "video", "audio": "audio"}

#: Fields of the structural pass.
FEATURES = (
    "title string, meta_description string, h1 string, html_lang string, canonical string, has_viewport boolean, page_size int, total_elements int, hidden_elements int, text_nodes int, "
    "word_count int, body_text_length int, long_paragraph boolean, heading_counts array<int>, h2_before_h1 boolean, "
    "tag_counts map<string,int>, images array<struct<src:string,alt:string,width:string,height:string,srcset:string,loading:string>>, n_images_no_alt_attr int, n_images_empty_alt int, n_images_long_alt int, "
    "links array<struct<position:int,href:string,url:string,text:string,rel:string,title:string,context:string>>, n_internal int, n_external int, n_nofollow int, n_empty_anchor int, n_generic_anchor int, "
    "hreflangs array<string>, og map<string,string>, twitter map<string,string>, json_ld array<string>, schema_types array<string>, has_schema_org boolean, n_microdata int, "
    "resources array<struct<url:string,type:string>>, n_inputs int, n_standard_names int, n_labelled int, n_typed int, n_required int, name_ratio double, label_ratio double, "
    "n_fields int, n_autocomplete int, autocomplete_ratio double, autocomplete_values array<string>, good_autocomplete boolean, has_llms_txt boolean, has_llms_link boolean, has_llms_meta boolean, llms_href string, has_ai_txt boolean, has_robots_txt boolean, robots_meta string, "
    "is_noindex boolean, is_nofollow boolean, is_noarchive boolean, has_restrictions boolean, "
    "has_captcha boolean, captcha_type string, has_recaptcha boolean, has_hcaptcha boolean, has_turnstile boolean, has_challenge boolean, has_bot_protection boolean, api_score int, has_api_docs boolean, has_api_meta boolean, has_openapi boolean, n_api_links int, n_state int, n_state_elements int, has_state boolean, has_auth_state boolean, has_validation boolean, has_error_state boolean, has_loading boolean, "
    "n_agent_elements int, n_agent_visible int, n_agent_hidden int, has_alert boolean, has_live boolean, has_persistent_errors boolean, has_invalid boolean, n_alerts int, n_live int, n_invalid int, n_field_errors int, n_tables int, tables_with_caption int, tables_with_scope int, machine_readable_ratio double, "
    "n_buttons int, n_disabled int, n_explained int, explained_ratio double, has_login boolean, has_logout boolean, has_account boolean, has_user_id boolean, text string, error string"
)


class _Tree(HTMLParser):
    """Elements in document order with attributes, parent and text; end tags close what they can."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.parents: list[int] = []
        self.spans: list[list[int]] = []
        self.texts: list[tuple[str, int]] = []
        self.stack: list[int] = []
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        found: dict[str, str] = {}
        for k, v in attrs:
            found.setdefault(k, v or "")
        self.tags.append(tag)
        self.attrs.append(found)
        self.parents.append(self.stack[-1] if self.stack else -1)
        self.spans.append([len(self.texts), len(self.texts)])
        if tag not in VOID:
            self.stack.append(len(self.tags) - 1)
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        closed = "" if self.open.get(tag) else tag
        while closed != tag:
            e = self.stack.pop()
            closed = self.tags[e]
            self.open[closed] -= 1
            self.spans[e][1] = len(self.texts)

    def handle_data(self, data: str) -> None:
        self.texts.append((data, self.stack[-1] if self.stack else -1))

    def finish(self) -> _Tree:
        self.close()
        for e in self.stack:
            self.spans[e][1] = len(self.texts)
        return self

    def text(self, e: int) -> str:
        a, b = self.spans[e]
        return "".join(t for t, _ in self.texts[a:b])

    def all(self, *tags: str) -> list[int]:
        return [k for k, t in enumerate(self.tags) if t in tags]


def _types(texts: list[str]) -> tuple[list[str], bool]:
    """Types of the objects that have one, and whether one of those names schema.org as its context (as a part of a text, or as an entry of a list)."""
    types, schema = [], False
    for t in texts:
        try:
            top = json.loads(t)
        except ValueError:
            continue
        kind = top.get("@type") if isinstance(top, dict) else None
        if kind:
            types += [str(x) for x in kind] if isinstance(kind, list) else [str(kind)]
            context = top.get("@context")
            schema = schema or (isinstance(context, (str, list)) and "schema.org" in context)
    return types, schema


def _share(part: int, whole: int) -> float:
    return part / whole if whole else 1.0


def features(page: str | None, url: str | None, base: str | None) -> dict:
    """All structural metrics of one page."""
    page, url, base = page or "", url or "", base or url or ""
    t = _Tree()
    try:
        t.feed(page)
    except AssertionError:  # declarations that the tokenizer gives up on end the page there
        pass
    t.finish()
    by: dict[str, list[int]] = {}
    for k, tag in enumerate(t.tags):
        by.setdefault(tag, []).append(k)

    def has(name: str) -> list[int]:
        return [k for k, a in enumerate(t.attrs) if name in a]

    def get(k: int, name: str) -> str:
        return t.attrs[k].get(name, "")

    def first(tag: str) -> str:
        return " ".join(t.text(by[tag][0]).split()) if tag in by else ""

    metas = {}
    for k in by.get("meta", []):
        name = (get(k, "name") or get(k, "property")).lower()
        if name:
            metas.setdefault(name, get(k, "content"))
    body = by.get("body", [-1])[0]
    body_text = t.text(body) if body >= 0 else "".join(x for x, _ in t.texts)
    clean = body_text.strip()
    images = [{"src": get(k, "src"), "alt": t.attrs[k].get("alt"), "width": t.attrs[k].get("width"), "height": t.attrs[k].get("height"), "srcset": t.attrs[k].get("srcset"), "loading": t.attrs[k].get("loading")} for k in by.get("img", [])]
    host = urlsplit(base).hostname or ""

    def absolute(href: str) -> str | None:
        try:
            return urljoin(url or base, href)
        except ValueError:
            return None

    landmark: list[str] = []  # the nearest one around each element
    for k, tag in enumerate(t.tags):
        up = t.parents[k]
        landmark.append("" if up < 0 else t.tags[up] if t.tags[up] in LANDMARKS else landmark[up])
    links, internal, external, nofollow, empty, generic = [], 0, 0, 0, 0, 0
    for position, k in enumerate(by.get("a", [])):
        href, text = get(k, "href"), " ".join(t.text(k).split())
        links.append({"position": position, "href": href, "url": absolute(href) if href else None, "text": text, "rel": t.attrs[k].get("rel"), "title": t.attrs[k].get("title"), "context": landmark[k]})
        if href.startswith("/") or (base and href.startswith(base)):
            internal += 1
        else:
            external += 1
        nofollow += "nofollow" in get(k, "rel")
        empty += not text
        generic += text.lower() in GENERIC_ANCHORS
    resources = []

    def resource(href: str, kind: str) -> None:
        href = href.strip()
        if href and not href.startswith(("#", "javascript:", "data:")) and (found := absolute(href)):
            resources.append({"url": found, "type": kind})

    def above(k: int) -> set[str]:
        found, up = set(), t.parents[k]
        while up >= 0:
            found.add(t.tags[up])
            up = t.parents[up]
        return found

    def sources(text: str, kind: str) -> None:
        for part in text.split(","):
            if part.strip():
                resource(part.split()[0], kind)

    for k in by.get("style", []):
        for face in FONT_FACE.findall(t.text(k)):
            for found in FONT_URL.findall(face):
                resource(found, "font")
    for k, tag in enumerate(t.tags):
        a = t.attrs[k]
        if tag == "script":
            resource(a.get("src", ""), "javascript")
        elif tag == "link" and a.get("rel", "").lower() == "stylesheet":
            resource(a.get("href", ""), "css")
        elif tag == "link" and a.get("rel", "") in HINTS:
            resource(a.get("href", ""), PRELOAD_TYPES.get(a.get("as", ""), "other"))
        elif tag == "img":
            resource(a.get("src", ""), "image")
        elif tag == "source":
            around = above(k)
            if "picture" in around:
                sources(a.get("srcset", ""), "image")
            if "video" in around:
                resource(a.get("src", ""), "video")
                sources(a.get("srcset", ""), "video")
            if "audio" in around:
                resource(a.get("src", ""), "audio")
        elif tag in ("object", "embed") and ("data" if tag == "object" else "src") in a:
            drawn = a.get("data", "") or a.get("src", "")
            if a.get("type", "").lower() == "image/svg+xml" or (absolute(drawn.strip()) or "").endswith(".svg"):
                resource(drawn, "image")
        elif tag in ("video", "audio"):
            resource(a.get("src", ""), tag)
        elif tag == "iframe":
            resource(a.get("src", ""), "iframe")
        if "background" in a.get("style", ""):
            for found in FONT_URL.findall(a["style"]):
                resource(found, "image")
    json_ld = [t.text(k) for k in by.get("script", []) if get(k, "type").lower() == "application/ld+json"]
    schema_types, schema_org = _types(json_ld)
    inputs = sorted(by.get("input", []) + by.get("select", []) + by.get("textarea", []))
    labelled_ids = {t.attrs[k]["for"] for k in by.get("label", []) if "for" in t.attrs[k]}
    named = sum(get(k, "name") in FIELD_NAMES or get(k, "id") in FIELD_NAMES for k in inputs)
    labelled = sum(bool(get(k, "aria-label")) or get(k, "id") in labelled_ids for k in inputs)
    fields = [k for k in inputs if get(k, "type").lower() not in ("hidden", "submit", "button")]
    completions = [get(k, "autocomplete") for k in fields if get(k, "autocomplete")]
    completed = len(completions)
    anchors = by.get("a", []) + by.get("link", [])
    llms = [get(k, "href") for k in anchors if "llms.txt" in get(k, "href")]
    llms_meta = any(get(k, "name") == "llms-txt" or get(k, "property") == "llms:txt" for k in by.get("meta", []))
    robots = metas.get("robots", "").lower()
    scripts = [get(k, "src") for k in by.get("script", [])]
    low = "".join(x for x, _ in t.texts).lower()
    classes = [set(a.get("class", "").split()) for a in t.attrs]
    recaptcha = bool(has("data-sitekey")) or any("g-recaptcha" in c for c in classes) or any("recaptcha" in s for s in scripts)
    hcaptcha = any("h-captcha" in c for c in classes) or any("hcaptcha" in s for s in scripts)
    cloudflare = any("cloudflare" in s for s in scripts)
    turnstile = (bool(has("data-sitekey")) or any("turnstile" in s for s in scripts)) and cloudflare
    challenge = cloudflare or any("cf-browser-verification" in c for c in classes)
    captcha = recaptcha or hcaptcha or turnstile or any(w in low for w in ROBOT_WORDS)
    fetched = [get(k, "src") or get(k, "href") for k in by.get("script", []) + by.get("link", [])]
    api_links = sum(any(x in get(k, "href") for x in ("/api", "/docs", "/swagger", "/openapi")) for k in by.get("a", []))
    docs = api_links > 0
    openapi = any(get(k, "rel") == "alternate" and get(k, "type") == "application/json" and re.search("openapi|swagger", get(k, "href")) for k in by.get("link", []))
    api = 25 * docs + 25 * bool(openapi) + 15 * any("/api/" in s or "/rest/" in s for s in fetched) + 15 * any("graphql" in s for s in fetched)
    visible = [get(k, "data-agent-visible") for k in has("data-agent-visible")]
    alerts, lives = sum(get(k, "role") == "alert" for k in has("role")), len(has("aria-live"))
    alert, live = alerts > 0, lives > 0
    invalid = sum(get(k, "aria-invalid") == "true" for k in has("aria-invalid"))
    tables = by.get("table", [])
    captions = sum("table" in above(k) for k in by.get("caption", []))
    scoped = any("scope" in t.attrs[k] for k in by.get("th", []))
    cells = by.get("td", [])
    buttons = sorted(by.get("button", []) + [k for k in by.get("input", []) if get(k, "type").lower() in ("submit", "button")])
    disabled = [k for k in buttons if "disabled" in t.attrs[k] and (t.tags[k] == "button" or get(k, "type").lower() == "submit")]
    explained = sum(bool(get(k, "title") or get(k, "aria-describedby") or get(k, "data-disabled-reason")) for k in disabled)
    hrefs = [get(k, "href") for k in by.get("a", [])]
    styles = [a.get("style", "") for a in t.attrs]
    headings = [len(by.get(f"h{k}", [])) for k in range(1, 7)]
    return {
        "title": first("title"),
        "meta_description": metas.get("description", ""),
        "h1": first("h1"),
        "html_lang": get(by["html"][0], "lang") if "html" in by else "",
        "canonical": next((get(k, "href") for k in by.get("link", []) if get(k, "rel").lower() == "canonical"), None),
        "has_viewport": "viewport" in metas,
        "page_size": len(page),
        "total_elements": len(t.tags),
        "hidden_elements": sum("display: none" in s or "visibility: hidden" in s or "hidden" in a for s, a in zip(styles, t.attrs, strict=True)),
        "text_nodes": sum(1 for x, owner in t.texts if owner == body and x.strip()),
        "word_count": len(clean.split()) if clean else 1,
        "body_text_length": len(clean),
        "long_paragraph": any(len(t.text(k).split()) > 300 for k in by.get("p", [])),
        "heading_counts": headings,
        "h2_before_h1": bool(headings[0] and headings[1] and by["h2"][0] < by["h1"][0]),
        "tag_counts": {k: len(v) for k, v in by.items()},
        "images": images,
        "n_images_no_alt_attr": sum(i["alt"] is None for i in images),
        "n_images_empty_alt": sum(i["alt"] is not None and not i["alt"].strip() for i in images),
        "n_images_long_alt": sum(len(i["alt"] or "") > 100 for i in images),
        "links": links,
        "n_internal": internal,
        "n_external": external,
        "n_nofollow": nofollow,
        "n_empty_anchor": empty,
        "n_generic_anchor": generic,
        "hreflangs": [get(k, "hreflang") for k in by.get("link", []) if get(k, "rel") == "alternate" and get(k, "hreflang")],
        "og": {k: v for k, v in metas.items() if k.startswith("og:")},
        "twitter": {k: v for k, v in metas.items() if k.startswith("twitter:")},
        "json_ld": json_ld,
        "schema_types": schema_types,
        "has_schema_org": schema_org,
        "n_microdata": len(has("itemscope")),
        "resources": resources,
        "n_inputs": len(inputs),
        "n_standard_names": named,
        "n_labelled": labelled,
        "n_typed": sum("type" in t.attrs[k] for k in inputs),
        "n_required": sum("required" in t.attrs[k] or get(k, "aria-required") == "true" for k in inputs),
        "name_ratio": _share(named, len(inputs)),
        "label_ratio": _share(labelled, len(inputs)),
        "n_fields": len(fields),
        "n_autocomplete": completed,
        "autocomplete_ratio": _share(completed, len(fields)),
        "autocomplete_values": list(dict.fromkeys(completions)),
        "good_autocomplete": _share(completed, len(fields)) >= 0.7,
        "has_llms_txt": bool(llms) or llms_meta,
        "has_llms_link": bool(llms),
        "has_llms_meta": llms_meta,
        "llms_href": llms[0] if llms else None,
        "has_ai_txt": any("ai.txt" in get(k, "href") for k in anchors),
        "has_robots_txt": any("robots.txt" in get(k, "href") for k in anchors),
        "robots_meta": robots,
        "is_noindex": "noindex" in robots,
        "is_nofollow": "nofollow" in robots,
        "is_noarchive": "noarchive" in robots,
        "has_restrictions": any(w in robots for w in ("noindex", "nofollow", "noarchive")),
        "has_captcha": captcha,
        "captcha_type": "reCAPTCHA" if recaptcha else "hCaptcha" if hcaptcha else "Turnstile" if turnstile else "Unknown" if captcha else "None",
        "has_recaptcha": recaptcha,
        "has_hcaptcha": hcaptcha,
        "has_turnstile": turnstile,
        "has_challenge": challenge,
        "has_bot_protection": captcha or challenge,
        "api_score": api,
        "has_api_docs": docs,
        "has_api_meta": any("api" in get(k, "name") or "api" in get(k, "property") for k in by.get("meta", [])),
        "has_openapi": openapi,
        "n_api_links": api_links,
        "n_state": len(has("data-state")),
        "n_state_elements": sum(any(x in a for x in STATES) for a in t.attrs),
        "has_state": bool(has("data-state")),
        "has_auth_state": bool(has("data-authenticated")),
        "has_validation": bool(has("data-validation-state")),
        "has_error_state": bool(has("data-error-code")),
        "has_loading": bool(has("data-loading")) or any(a.get("data-state") == "loading" for a in t.attrs),
        "n_agent_elements": len(visible),
        "n_agent_visible": sum(v in ("", "true") for v in visible),
        "n_agent_hidden": sum(v == "false" for v in visible),
        "has_alert": alert,
        "has_live": live,
        "has_persistent_errors": alert and live,
        "has_invalid": invalid > 0,
        "n_alerts": alerts,
        "n_live": lives,
        "n_invalid": invalid,
        "n_field_errors": sum("error" in a.get("class", "") for a in t.attrs),
        "n_tables": len(tables),
        "tables_with_caption": captions,
        "tables_with_scope": len(tables) if scoped else 0,
        "machine_readable_ratio": sum(any(get(k, x) for x in CELL_DATA) for k in cells) / len(cells) if cells else 0.0,
        "n_buttons": len(buttons),
        "n_disabled": len(disabled),
        "n_explained": explained,
        "explained_ratio": _share(explained, len(disabled)),
        "has_login": any(x in h for h in hrefs for x in ("login", "signin", "sign-in")),
        "has_logout": any(x in h for h in hrefs for x in ("logout", "signout", "sign-out")) or any("logout" in get(k, "action") for k in by.get("form", [])),
        "has_account": any("account" in h or "profile" in h for h in hrefs),
        "has_user_id": bool(has("data-user-id") or has("data-user-name") or has("data-user-email")),
        "text": " ".join(clean.split()),
        "error": None,
    }


def guarded(page: str | None, url: str | None, base: str | None) -> dict:
    """The same, or for a page that the pass fails on the metrics of an empty one, with what went wrong in ``error``."""
    try:
        return features(page, url, base)
    except Exception as e:  # whatever a page does, it is that page's own failure and not the task's
        return features(None, None, None) | {"error": f"{type(e).__name__}: {e}"[:200]}


def page_features(pages: DataFrame, base: str | None = None, columns: list[str] | None = None, wanted: list[str] | None = None) -> DataFrame:
    """``columns`` of every page (default: its url) and the fields of FEATURES (or those ``wanted``) as columns.

    One Python pass: filter and prune before it, score with expressions after it. A null or empty page has empty metrics; one that the pass fails on has them too, and
    says so in ``error``."""
    ship(pages.sparkSession)
    columns = columns or ["url"]
    fields = [f for f in T.StructType.fromDDL(FEATURES).fields if wanted is None or f.name in wanted]
    schema = T.StructType([*(pages.schema[c] for c in columns), *fields])
    out = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in fields]
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                rows = []
                for html, url in zip(part.column("_html").to_pylist(), part.column("_url").to_pylist(), strict=True):
                    found = guarded(html, url, base)
                    rows.append({n: found[n] for n in names})
                made = pa.RecordBatch.from_pylist([{k: list(v.items()) if isinstance(v, dict) else v for k, v in r.items()} for r in rows], schema=out)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *made.columns], names=[*columns, *names])

    return pages.select(*columns, F.col("html").alias("_html"), F.col("url").alias("_url")).mapInArrow(run, schema)

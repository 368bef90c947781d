"""What a page request can ask for, checked when the plan is built. No Spark here."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

from .html.writer import Dialect

FORMATS = ("content", "markdown", "html", "text", "pageshot", "screenshot", "vlm", "frontmatter")
IMAGE_MODES, LINK_MODES = ("none", "all", "alt", "all_p", "alt_p"), ("none", "all", "text", "gpt-oss")
ENGINES, TIMINGS = ("auto", "browser", "curl", "cf-browser-rendering"), ("html", "visible-content", "mutation-idle", "resource-idle", "media-idle", "network-idle")
#: Texts that mean false.
FALSE_TEXTS = ("", "false", "none", "null", "nan", "nil", "0", "no", "undefined")
LEAST_MAX_TOKENS, LONGEST_TIMEOUT = 500, 180


class BadOption(ValueError):
    pass


def truthy(value: Any) -> bool:
    return value if isinstance(value, bool) else value is not None and str(value).strip().lower() not in FALSE_TEXTS


@dataclass(frozen=True)
class Options:
    url: str | None = None
    html: str | None = None
    base: str = "initial"
    respond_with: str = "content"
    retain_images: str = "all"
    retain_links: str = "all"
    with_generated_alt: bool = False
    with_links_summary: str | bool = False
    with_images_summary: bool = False
    with_iframe: str | bool = False
    with_shadow_dom: bool = False
    main_content: bool = False  # find it by text density where the capture has none
    no_gfm: str | bool = False
    no_cache: bool = False
    cache_tolerance: int | None = None  # milliseconds
    keep_img_data_url: bool = False
    target_selector: tuple[str, ...] = ()
    wait_for_selector: tuple[str, ...] = ()
    remove_selector: tuple[str, ...] = ()
    remove_overlay: bool = False
    inject_page_script: tuple[str, ...] = ()
    viewport: tuple[int, int] | None = None
    instruction: str | None = None
    set_cookies: tuple[str, ...] = ()
    user_agent: str | None = None
    locale: str | None = None
    proxy: str | None = None
    proxy_url: str | None = None
    referer: str | None = None
    timeout: int | None = None
    respond_timing: str | None = None
    engine: str = "auto"
    token_budget: int | None = None
    max_tokens: int | None = None
    markdown_chunking: str | bool = False
    markdown: Dialect = field(default_factory=Dialect)

    def __post_init__(self) -> None:
        checks = (("retain_images", IMAGE_MODES), ("retain_links", LINK_MODES), ("engine", ENGINES), ("base", ("initial", "final")), ("respond_timing", (None, *TIMINGS)))
        for name, allowed in checks:
            if getattr(self, name) not in allowed:
                raise BadOption(f"{name}: {getattr(self, name)!r}")
        if self.max_tokens is not None and self.max_tokens < LEAST_MAX_TOKENS:
            raise BadOption(f"max_tokens is {LEAST_MAX_TOKENS} at least")
        for s in (*self.target_selector, *self.remove_selector, *self.wait_for_selector):
            if any(re.match(r"[*:]", p.strip()) or "*:" in p for p in s.split(",")):
                raise BadOption(f"selector {s!r} matches too much")

    @property
    def formats(self) -> tuple[str, ...]:
        return tuple(f.strip() for f in re.split(r"[,+|]", self.respond_with) if f.strip()) or ("content",)

    # Predicates

    @property
    def is_compound(self) -> bool:
        return self.respond_with not in FORMATS

    @property
    def readability_required(self) -> bool:
        return self.respond_timing == "visible-content" or not self.respond_with or "content" in self.respond_with

    @property
    def timing(self) -> str:
        """When a page counts as ready."""
        if self.respond_timing:
            return self.respond_timing
        if self.timeout is not None and self.timeout >= 20:
            return "network-idle"
        if self.with_iframe:
            return "network-idle"
        if re.search(r"shot|vlm", self.respond_with):
            return "media-idle"
        return "resource-idle"

    @property
    def browser_not_required(self) -> bool:
        return not (re.search(r"shot|vlm", self.respond_with) or self.timing not in ("html", "resource-idle") or self.with_iframe or self.with_shadow_dom or self.inject_page_script or self.viewport or self.instruction or self.remove_overlay)

    @property
    def cache_applicable(self) -> bool:
        return not (self.no_cache or self.cache_tolerance == 0 or self.set_cookies or self.inject_page_script or self.viewport or self.instruction or self.remove_overlay)

    @property
    def chunk_mode(self) -> tuple[str, int] | None:
        """(contextual or simple, depth). The two names mean what they say; otherwise a value with a leading s is contextual."""
        if not truthy(self.markdown_chunking):
            return None
        value = str(self.markdown_chunking)
        digit = re.search(r"(\d)$", value)
        mode = value if value in ("simple", "contextual") else "contextual" if value.startswith("s") else "simple"
        return mode, int(digit[1]) if digit else 4

    def customised(self) -> dict[str, Any]:
        """What differs from the defaults, without payloads."""
        plain = Options()
        return {f.name: v for f in fields(self) if (v := getattr(self, f.name)) != getattr(plain, f.name) and f.name not in ("html", "set_cookies", "proxy_url")}

    def acceptable_early(self, snapshot: Mapping[str, Any]) -> bool:
        """Whether a snapshot can be the answer before the page has come to rest."""
        timing = self.timing
        idle = lambda key: (snapshot.get(key) or 0) + 500 <= (snapshot.get("now") or 0)
        if timing == "html" and snapshot.get("html"):
            return True
        if timing == "visible-content" and (snapshot.get("parsed") or {}).get("content"):
            return True
        if timing == "mutation-idle" and snapshot.get("lastMutationIdle"):
            return True
        if timing == "media-idle":
            return bool(snapshot.get("lastMutationIdle")) and idle("lastMediaResourceLoaded")
        if timing == "resource-idle":
            return bool(snapshot.get("lastMutationIdle")) and idle("lastContentResourceLoaded")
        return False

    @classmethod
    def of(cls, body: Mapping[str, Any] | None = None, headers: Mapping[str, str] | None = None) -> Options:
        """From a request's body (camelCase) and headers, headers winning."""
        body, headers = dict(body or {}), {k.lower(): v for k, v in (headers or {}).items()}
        given: dict[str, Any] = {}
        names = {f.name for f in fields(cls)}
        for k, v in body.items():
            name = re.sub(r"(?<!^)(?=[A-Z])", "_", k).lower()
            if name in names and v is not None:
                given[name] = v
        for name in names:
            key = "x-" + name.replace("_", "-")
            if key in headers:
                given[name] = headers[key]
        for name in ("target_selector", "remove_selector", "wait_for_selector", "set_cookies", "inject_page_script"):
            v = given.get(name)
            if v is not None:
                given[name] = tuple(v) if isinstance(v, (list, tuple)) else tuple(str(v).split(", ")) if "x-" + name.replace("_", "-") in headers else (v,)
        for name in ("with_generated_alt", "with_images_summary", "with_shadow_dom", "main_content", "no_cache", "keep_img_data_url", "remove_overlay"):
            if name in given:
                given[name] = truthy(given[name])
        for name in ("with_links_summary", "with_iframe", "no_gfm"):
            if name in given:
                v = given[name]
                given[name] = v if isinstance(v, bool) else str(v) if truthy(v) and str(v).lower() != "true" else truthy(v)
        for name in ("token_budget", "max_tokens", "cache_tolerance"):
            if name in given:
                given[name] = int(given[name])
        if "cache_tolerance" in given:
            given["cache_tolerance"] *= 1000
        if "timeout" in given:
            try:
                given["timeout"] = min(int(given["timeout"]), LONGEST_TIMEOUT) if int(given["timeout"]) > 0 else None
            except (TypeError, ValueError):
                given["timeout"] = None
        md = {re.sub(r"(?<!^)(?=[A-Z])", "_", k).lower(): v for k, v in (given.pop("markdown", None) or {}).items()}
        md |= {k[5:].replace("-", "_"): v for k, v in headers.items() if k.startswith("x-md-")}
        given["markdown"] = Dialect(**{k: v for k, v in md.items() if k in {f.name for f in fields(Dialect)}})
        if "viewport" in given and isinstance(given["viewport"], Mapping):
            given["viewport"] = (int(given["viewport"].get("width", 0)), int(given["viewport"].get("height", 0)))

        # Options that follow from others.
        form = given.get("respond_with") or ""
        if re.search(r"lm", form) and re.search(r"content|markdown", form):
            raise BadOption("a language model's format can't be asked for with content or markdown")
        if "lm" in (given.get("engine") or ""):  # a language model as an engine is a format
            given["respond_with"], given["engine"] = given["engine"], "auto"
        if given.get("with_generated_alt"):
            given["retain_images"] = "all_p"
        if given.get("retain_links") == "gpt-oss":
            given["with_links_summary"] = "gpt-oss"
        if given.get("no_cache"):
            given["cache_tolerance"] = 0
        if given.get("target_selector") and not given.get("wait_for_selector"):
            given["wait_for_selector"] = given["target_selector"]
        if given.get("with_iframe") or given.get("with_shadow_dom"):
            given["timeout"] = None
        found = cls(**given)
        if found.chunk_mode and found.markdown.heading_style != "atx":
            found = replace(found, markdown=replace(found.markdown, heading_style="atx"))
        return found

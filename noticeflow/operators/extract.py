"""Extraction from pages and texts.

One mapInArrow pass parses each page once and gives out one row with all that it
found; mapping, precedence and states are expressions over that row, so nothing
is shuffled.  Texts need built-in expressions only.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.dates import parse_date
from noticeflow.functions.status import utility_status
from noticeflow.functions.text import SPACES, first_seen_distinct, once
from noticeflow.operators.score import worked_once

#: Page labels -> canonical fields.
LABELS = {
    "ticket_number": ["ticket number", "ticket #"],
    "county": ["county"],
    "call_date": ["call date", "called date"],
    "legal_start_date": ["legal start", "legal start date", "work to begin"],
    "expiration_date": ["expiration", "expiration date", "expires", "good until", "expire date"],
    "excavator_name": ["excavator", "excavator name", "excavating company", "company"],
    "caller_name": ["caller", "caller name"],
    "caller_phone": ["phone", "caller phone"],
    "work_type": ["work type", "type of work", "work description"],
    "location_text": ["location", "location description", "street address", "work street address", "address"],
    "intersection_text": ["intersection"],
    "remarks": ["remarks", "comments", "additional information"],
    "done_for": ["done for", "done for company", "work done for", "work for", "for company"],
    "latitude": ["latitude"],
    "longitude": ["longitude"],
    "secondary_latitude": ["secondary lat"],
    "secondary_longitude": ["secondary long"],
}
#: Patterns of labelled texts, by field, in the order they are tried.
_MORE = r"([^\n]+(?:\n(?!\w+\s*[:\-])[^\n]+)*)"
TEXT_PATTERNS = {
    "ticket_number": [r"ticket\s*(?:number|#|no\.?)\s*[:\-]\s*(\S+)", r"locate\s*request\s*#?\s*[:\-]\s*(\S+)"],
    "county": [r"county\s*[:\-]\s*([^\n]+)"],
    "call_date": [r"call\s*date\s*[:\-]\s*([^\n]+)", r"called\s*date\s*[:\-]\s*([^\n]+)", r"date\s*called\s*[:\-]\s*([^\n]+)"],
    "legal_start_date": [r"legal\s*start(?:\s*date)?\s*[:\-]\s*([^\n]+)", r"start\s*date\s*[:\-]\s*([^\n]+)"],
    "expiration_date": [r"expir(?:ation|es?)\s*(?:date)?\s*[:\-]\s*([^\n]+)", r"valid\s*until\s*[:\-]\s*([^\n]+)"],
    "excavator_name": [r"excavat(?:or|ing\s*company)\s*[:\-]\s*([^\n]+)", r"company\s*[:\-]\s*([^\n]+)", r"contractor\s*[:\-]\s*([^\n]+)"],
    "caller_name": [r"caller(?:\s*name)?\s*[:\-]\s*([^\n]+)", r"contact(?:\s*name)?\s*[:\-]\s*([^\n]+)"],
    "caller_phone": [r"(?:caller\s*)?phone\s*[:\-]\s*([^\n]+)", r"telephone\s*[:\-]\s*([^\n]+)"],
    "work_type": [r"(?:type\s*of\s*)?work(?:\s*type)?\s*[:\-]\s*([^\n]+)", r"work\s*description\s*[:\-]\s*([^\n]+)"],
    "location_text": [r"location(?:\s*description)?\s*[:\-]\s*" + _MORE, r"address\s*[:\-]\s*([^\n]+)", r"street\s*[:\-]\s*([^\n]+)"],
    "remarks": [r"remarks?\s*[:\-]\s*" + _MORE, r"comments?\s*[:\-]\s*" + _MORE, r"additional\s*(?:information|info)\s*[:\-]\s*" + _MORE, r"notes?\s*[:\-]\s*" + _MORE],
    "done_for": [r"done\s*for\s*[:\-]\s*([^\n]+)", r"work\s*(?:done\s*)?for\s*[:\-]\s*([^\n]+)", r"for\s*company\s*[:\-]\s*([^\n]+)"],
}
MENTION_LABEL = r"(?i)utility[:\s]+([^\n]+)"
MENTION_RUN = r"(?<![A-Za-z\s&,])([A-Za-z\s&,]++)[:\-]"
MENTION_TRADES = r"(?is)^.+(?:electric|gas|water|sewer|telecom|cable|fiber)"
KEY_FIELDS = ["ticket_number", "county", "call_date", "expiration_date", "excavator_name"]
DATE_FIELDS = ("call_date", "legal_start_date", "expiration_date")
#: Words that mark a cancelled notice.
CANCEL_WORDS = ["cancelled", "canceled", "void"]
VOID_TAGS = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Tree(HTMLParser):
    """A page as nested lists [tag, attributes, children]; text is str."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in VOID_TAGS:
            self.open.append(node)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        self.open[-1][2].append(data)


def _all(node, *tags):
    stack = [c for c in reversed(node[2]) if not isinstance(c, str)]
    while stack:
        n = stack.pop()
        if n[0] in tags:
            yield n
        stack.extend(c for c in reversed(n[2]) if not isinstance(c, str))


def _texts(node):
    """Stripped pieces of text below a node, in order; scripts and styles are not text."""
    stack = list(reversed(node[2]))
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            if n.strip():
                yield n.strip()
        elif n[0] not in ("script", "style"):
            stack.extend(reversed(n[2]))


def _text(node) -> str:
    return "".join(_texts(node))


def _page_rows(html: str):
    """(kind, pos, values...) rows of one page: labels by strategy, responses, codes, marks and the whole text."""
    tree = _Tree(html)
    root = tree.root
    out = []
    add = lambda kind, *values: out.append((kind, len(out), *(list(values) + [None] * (8 - len(values)))))
    for row in _all(root, "tr"):
        th, tds = next(_all(row, "th"), None), list(_all(row, "td"))
        if th is not None and tds:
            add("th", _text(th), _text(tds[0]))
        if len(tds) == 4:
            add("td", _text(tds[0]), _text(tds[1]))
            add("td", _text(tds[2]), _text(tds[3]))
        elif len(tds) >= 2:
            add("td", _text(tds[0]), _text(tds[1]))
    for parent in [root, *(_all(root, "dl"))]:
        items = [c for c in parent[2] if not isinstance(c, str)]
        for i, c in enumerate(items):
            if c[0] == "dt":
                dd = next((d for d in items[i + 1 :] if d[0] == "dd"), None)
                if dd is not None:
                    add("dt", _text(c), _text(dd))
    for div in _all(root, "div"):
        if "generalInformation" not in (div[1].get("class") or "").split():
            continue
        h3, table = next(_all(div, "h3"), None), next(_all(div, "table"), None)
        if h3 is None or table is None or not _text(h3).startswith("Response Status"):
            continue
        for row in _all(table, "tr"):
            tds = list(_all(row, "td"))
            if len(tds) < 4:
                continue
            name = []
            for c in tds[2][2]:
                if not isinstance(c, str) and c[0] == "ul":
                    break
                name.append(c.strip() if isinstance(c, str) else _text(c))
            items = list(_all(tds[2], "li"))
            inner = lambda tag: next((_text(n) for n in _all(items[-1], tag)), None) if items else None
            add("response", _text(tds[0]), _text(tds[1]).upper(), " ".join(x for x in name if x), _text(tds[3]), inner("span"), inner("b"), inner("div") or "", str(len(items)))
        break
    for table in _all(root, "table"):
        rows = list(_all(table, "tr"))
        cells = list(_all(rows[0], "th", "td")) if rows else []
        if not cells or _text(cells[0]).lower() != "code":
            continue
        codes = [_text(c[0]).strip().upper() for r in rows[1:] if (c := list(_all(r, "td", "th")))]
        if any(codes):
            for code in codes:
                if code:
                    add("code", code)
            break
    add("text", " ".join(_texts(root)))
    for node in _all(root, "h1", "h2", "h3", "span", "div", "td"):
        said = _text(node).lower()
        if any(w in said for w in CANCEL_WORDS):
            add("cancel", said[:200])
            break
    return out


RESPONSE_FIELDS = ("row_status", "code", "name", "facility", "last_response", "response_timestamp", "notes", "response_count")
ITEMS = (
    "labels array<struct<pos:int,kind:string,label:string,value:string>>, responses array<struct<" + ",".join(f"{c}:string" for c in RESPONSE_FIELDS) + ">>, "
    "codes array<string>, raw_text string, mark string"
)


def page_items(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, labels, responses, codes, raw_text, mark): everything the page parser finds, one row per page.

    A null page is an empty one; repeated rows are parsed alike; other columns
    are not read; an empty table gives an empty result.
    """

    def work(batches):
        import pyarrow as pa

        text = pa.string()
        label = pa.struct([("pos", pa.int32()), ("kind", text), ("label", text), ("value", text)])
        response = pa.struct([(c, text) for c in RESPONSE_FIELDS])
        kinds = [pa.list_(label), pa.list_(response), pa.list_(text), text, text]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows = []
                for html in batch.column(1):
                    found = _page_rows(html.as_py() or "")
                    of = lambda *wanted: [r for r in found if r[0] in wanted]  # noqa: B023, E731
                    labels = [{"pos": r[1], "kind": r[0], "label": r[2], "value": r[3]} for r in of("th", "td", "dt")]
                    responses = [dict(zip(RESPONSE_FIELDS, r[2:])) for r in of("response")]
                    rows.append((labels, responses, [r[2] for r in of("code")], of("text")[0][2], next((r[2] for r in of("cancel")), None)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]], [key, "labels", "responses", "codes", "raw_text", "mark"]
                )

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInArrow(work, f"{key} {kind}, {ITEMS}")


def chosen_labels() -> Column:
    """array<(pos, label, value)>: header rows, or plain rows on pages where no header label is known, then definition lists."""
    known = [label for names in LABELS.values() for label in names]
    clean = F.transform("labels", lambda x: F.struct(
        (x["pos"] + F.when(x["kind"] == "dt", 1_000_000).otherwise(0)).alias("pos"), x["kind"].alias("kind"), F.regexp_replace(F.lower(x["label"]), ":+$", "").alias("label"), x["value"].alias("value")
    ))
    headed = F.exists(clean, lambda x: (x["kind"] == "th") & x["label"].isin(known))
    used = F.filter(clean, lambda x: (x["kind"] != "td") | ~headed)
    return F.transform(F.array_sort(used), lambda x: x.dropFields("kind"))


def _fields(labels: str) -> list[Column]:
    """The canonical fields from chosen labels: unknown labels go, the last occurrence wins."""
    last = lambda names: F.try_element_at(F.filter(labels, lambda x: x["label"].isin(names)), F.lit(-1))["value"]
    return [last(names).alias(field) for field, names in LABELS.items()]


def page_labels(items: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, label, value): the labels that count, a row each."""
    return items.select(key, F.inline(chosen_labels()))


def map_labels(items: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per page with the canonical fields; unknown labels go, the last occurrence wins."""
    return items.withColumn("__labels", chosen_labels()).select(key, *_fields("__labels"))


def states_of_responses() -> Column:
    """array of utility responses with their derived state, in order of the page."""
    return F.transform("responses", lambda r: F.struct(
        r["code"].alias("code"), r["name"].alias("name"), r["facility"].alias("facility"), r["row_status"].alias("row_status"), r["last_response"].alias("last_response"),
        r["response_timestamp"].alias("response_timestamp"), r["response_count"].cast("int").alias("response_count"), r["notes"].alias("notes"),
        utility_status(r["row_status"], r["last_response"]).alias("status"),
    ))


def page_responses(items: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per utility response with its derived state."""
    return items.select(key, F.posexplode(states_of_responses()).alias("pos", "r")).select(key, "pos", "r.*")


#: Fixed value: a code beside one of these words.
CODE_NEAR_WORD = r"(?i)\b([A-Z]{2,8})\b(?=\s*[-:|\s]?\s*(?:utility|notified|response|locate|marked))"


def codes_of_page() -> Column:
    """Codes of the code table, else of the responses, else of the text; distinct, upper-cased, in order."""
    scan = F.transform(F.regexp_extract_all("raw_text", F.lit(CODE_NEAR_WORD), 1), lambda c: F.upper(c))
    clean = lambda c: F.array_distinct(F.filter(c, lambda x: x != ""))
    own, said = clean(F.col("codes")), clean(F.transform("responses", lambda r: r["code"]))
    return F.when(F.size(own) > 0, own).when(F.size(said) > 0, said).otherwise(clean(scan))


def page_codes(items: DataFrame, key: str = "page_id") -> DataFrame:
    return items.select(key, codes_of_page().alias("utility_codes"))


def cancelled_page(word_boundary: bool = False) -> Column:
    """By default 'avoid' contains 'void', with word_boundary it does not."""
    sure = F.col("raw_text").rlike(r"(?i)\b(cancelled|canceled|void)\b") if word_boundary else F.lit(True)
    return F.col("mark").isNotNull() & sure


def page_flags(items: DataFrame, key: str = "page_id", word_boundary: bool = False) -> DataFrame:
    return items.select(key, "raw_text", cancelled_page(word_boundary).alias("is_cancelled"))


def page_details(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Everything a page tells about its notice, one row per page, ready for normalize_tickets once ticket_number is set."""
    rows = page_items(pages, key, html).withColumn("__labels", chosen_labels())
    states = states_of_responses()
    return rows.select(
        key, "raw_text", cancelled_page().alias("is_cancelled"), *_fields("__labels"), codes_of_page().alias("utility_codes"),
        F.when(F.size("responses") > 0, states).alias("utility_statuses"),
    )


# -- texts -------------------------------------------------------------------


def _first(text: Column, patterns: list[str]) -> Column:
    """The first pattern's first capture that is not blank, trimmed."""
    found = F.array(*[F.regexp_extract(text, f"(?im){p}", 1) for p in patterns])
    tidy = F.transform(found, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.try_element_at(F.filter(tidy, lambda x: x != ""), F.lit(1))


def extract_fields(docs: DataFrame, text_col: str = "text", county_hint: str = "") -> DataFrame:
    """Add the twelve labelled fields, utility_references, is_cancelled and positional.

    Strings are collapsed and cut to 500 characters; a date that can't be read
    ends the search for its field.  With fewer than two key fields, number and
    expiry are filled by position: a TN number anywhere, the last of two or more dates.
    """
    plain = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\r\n?", "\n")
    docs, text = worked_once(docs, {"__plain": plain}), F.col("__plain")
    raw = {f: _first(text, p) for f, p in TEXT_PATTERNS.items()}
    fields = {f: once(c, parse_date) if f in DATE_FIELDS else F.left(F.trim(F.regexp_replace(c, SPACES, " ")), F.lit(500)) for f, c in raw.items()}
    out = docs.withColumns(fields)
    few = sum(F.col(f).isNotNull().cast("int") for f in KEY_FIELDS) < 2
    # fixed value: how a date is written that counts by position
    dates = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\d{1,2}/\d{1,2}/\d{4}"), 0), parse_date), lambda d: d.isNotNull())
    last = once(dates, lambda d: F.when(F.size(d) >= 2, F.try_element_at(d, F.lit(-1))))
    number = F.nullif(F.upper(F.regexp_extract(text, r"(?i)\bTN[\d\-]{8,}\b", 0)), F.lit(""))
    out = out.withColumn("positional", few)
    return out.withColumns({
        "ticket_number": F.coalesce("ticket_number", F.when(F.col("positional"), number)),
        "expiration_date": F.coalesce("expiration_date", F.when(F.col("positional"), last)),
        "county": F.coalesce("county", F.nullif(F.lit(county_hint), F.lit(""))),
        "utility_references": extract_mentions(F.col(text_col)),
        "is_cancelled": cancelled_in_text(F.col(text_col)),
    }).drop("__plain")


def extract_mentions(text: Column, most: int = 20) -> Column:
    """Utilities that a text names: at most 100 characters each, longer than two, first spelling of each, the first 20."""
    given = F.coalesce(text, F.lit(""))
    found = F.concat(F.regexp_extract_all(given, F.lit(MENTION_LABEL), 1), trade_runs(given))
    tidy = F.filter(F.transform(found, lambda m: F.left(F.trim(F.regexp_replace(m, r"^\s+|\s+$", "")), F.lit(100))), lambda m: F.char_length(m) > 2)
    return once(tidy, lambda found: F.slice(first_seen_distinct(found, ignore_case=True), 1, most))


def trade_runs(text: Column) -> Column:
    """Runs of letters before a colon or hyphen that name a trade after their first character: found at run starts only, in linear time."""
    return F.filter(F.regexp_extract_all(text, F.lit(MENTION_RUN), 1), lambda m: m.rlike(MENTION_TRADES))


def cancelled_in_text(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)\b(?:cancelled|canceled|void(?:ed)?)\b"), F.lit(False))

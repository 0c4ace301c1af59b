"""The generators: name, match rule and expression of each, in order of registration (ties in
inference go to the earlier one)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from .dialect import Dialect

# Match scores.
FK, STRONG, NAME, WEAK_NAME, TYPE, WEAK, NO_MATCH = 100, 90, 70, 60, 40, 10, 0

# Type names by family.
TEXT = ("text", "character varying", "varchar", "character", "char", "citext")
INT = ("smallint", "integer", "bigint", "int", "int2", "int4", "int8")
NUMERIC = ("numeric", "decimal", "real", "double precision", "float", "float4", "float8")
STAMP = ("timestamp without time zone", "timestamp with time zone", "timestamptz", "timestamp")
JSON = ("json", "jsonb")
FAMILIES = {"text": TEXT, "int": INT, "numeric": NUMERIC, "stamp": STAMP, "json": JSON}
UDTS = ("inet", "point", "time", "timetz", "interval", "tstzrange", "hstore")
ARRAY_KINDS = {
    "text": ("text", "varchar", "character varying", "bpchar", "char", "citext"),
    "int": ("int2", "int4", "int8", "smallint", "integer", "bigint", "int"),
    "numeric": ("numeric", "decimal", "float4", "float8", "real", "double precision"),
    "bool": ("bool", "boolean"),
    "uuid": ("uuid",),
    "json": ("json",),
    "jsonb": ("jsonb",),
}

# Pools.
FIRST_NAMES = (
    "James Emma Oliver Sophia Liam Ava Noah Isabella Santiago Valentina Mateo Camila Sebastián Sofía Lucas Léa Hugo Chloé Théo Manon "
    "Leon Mia Paul Hannah Felix Laura Aarav Priya Arjun Ananya Rohan Kavya Omar Fatima Ali Layla Yusuf Noor Wei Fang Jian Xia Ming Ying "
    "Haruto Yui Sota Hina Ren Sakura Amara Kofi Zara Kwame Nia Seun Ivan Anna Dmitry Elena Nikita Natasha"
).split()
LAST_NAMES = (
    "Smith Johnson Williams Brown Jones Garcia Miller Davis González Rodríguez López Martínez Hernández Pérez Martin Bernard Dubois "
    "Thomas Robert Richard Müller Schmidt Schneider Fischer Weber Meyer Sharma Patel Singh Kumar Gupta Joshi Al-Farsi Hassan Ibrahim "
    "Khalil Mansour Qureshi Wang Li Zhang Liu Chen Yang Sato Suzuki Tanaka Watanabe Ito Yamamoto Osei Mensah Diallo Nkosi Banda Okonkwo "
    "Ivanov Petrov Smirnov Kuznetsov Novak Kowalski"
).split()
PATRONYMICS = (
    "Aleksandrovich,Alekseyevich,Vladimirovich,Dmitrievich,Ivanovich,Mikhailovich,Nikolayevich,Pavlovich,Petrovich,Sergeyevich,"
    "Aleksandrovna,Alekseyevna,Vladimirovna,Dmitrievna,Ivanovna,Mikhailovna,Nikolayevna,Pavlovna,Petrovna,Sergeyevna,"
    "Abenuly,Nurlanuly,Askaruly,Berikuly,Dauletkhanuly,Abenkyzy,Nurlankyzy,Askarkyzy,Berikkyzy,Dauletkhankyzy,"
    "Aliyev oglu,Mammadov oglu,Hasanov oglu,Huseynov oglu,Aliyeva qizi,Mammadova qizi,Hasanova qizi,Huseynova qizi,"
    "Beridze-shvili,Kvaratskhelia-shvili,Chikvanaia-shvili,Hakobyan,Sargsyan,Petrosyan,Grigoryan,"
    "Karimov ogli,Rahimov ogli,Toshmatov ogli,Karimova qizi,Rahimova qizi,Toshmatova qizi,Rahmonzoda,Nazarov-zoda,Karimzoda"
).split(",")
CITIES = (
    "New York,Los Angeles,Chicago,Toronto,Mexico City,São Paulo,Buenos Aires,Bogotá,Lima,Santiago,London,Paris,Berlin,Madrid,Rome,"
    "Amsterdam,Vienna,Warsaw,Moscow,Saint Petersburg,Kyiv,Prague,Budapest,Dubai,Istanbul,Cairo,Lagos,Nairobi,Casablanca,Mumbai,Delhi,"
    "Bangalore,Karachi,Dhaka,Tokyo,Shanghai,Beijing,Seoul,Jakarta,Bangkok,Singapore,Sydney,Melbourne,Auckland"
).split(",")
COUNTRIES = "US GB CA AU NZ DE FR ES IT NL PL SE NO CH AT RU UA CZ HU RO CN JP KR IN ID TH SG VN PH MY BR MX AR CO CL PE ZA NG KE EG MA GH TR SA AE IL PK BD".split()
COMPANIES = "Acme,Globex,Initech,Umbrella,Soylent,Wayne Enterprises,Stark Industries".split(",")
DIAL_CODES = "+1 +7 +44 +49 +33 +81 +86 +91 +55 +52 +61 +27 +234 +971".split()
SLUG_WORDS = "alpha beta gamma delta epsilon zeta theta lambda sigma omega".split()
TITLE_ADJECTIVES = "Новый Современный Основной Передовой Практический Базовый Расширенный Специальный".split()
TITLE_NOUNS = "курс модуль раздел урок блок тема материал проект".split()
USER_ADJECTIVES = "fast bold quiet bright cool dark swift sharp".split()
TLDS = "com net org io".split()
CURRENCIES = "USD EUR RUB GBP JPY CNY CHF CAD AUD KZT".split()
LANGUAGES = "en ru zh de fr es pt ar hi ja ko tr it pl".split()
MIME_TYPES = (
    "image/png image/jpeg image/gif image/webp application/pdf application/zip video/mp4 audio/mpeg text/plain text/csv "
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet application/vnd.openxmlformats-officedocument.wordprocessingml.document"
).split()
HTTP_CODES = (200, 201, 204, 301, 302, 400, 401, 403, 404, 409, 422, 500, 502, 503)
EXTENSIONS = "pdf docx xlsx png jpg zip csv mp4".split()
HSTORE_KEYS = "lang locale theme mode version format encoding".split()
LOCALIZED = ("name", "title", "description", "text", "label", "caption", "heading", "localized", "button_name")

DAY = 86_400_000_000
ANCHOR_DAYS = 19_723  # 2024-01-01
ANCHOR = ANCHOR_DAYS * DAY


@dataclass(frozen=True)
class Column:
    """What a match rule may see of a column."""

    name: str = ""
    data_type: str = ""
    udt: str = ""
    array_dims: int = 0
    enum_values: tuple = ()
    fk_target: str = ""
    precision: int | None = None
    scale: int | None = None

    def families(self) -> list[str]:
        """Names under which match rules find the column."""
        kind, udt = self.data_type.lower(), self.udt.lower()
        out = [n for n, names in FAMILIES.items() if kind in names]
        if "int" in out:
            orphan = self.name.lower().endswith("_id") and not self.fk_target
            out.append("int:orphan" if orphan else "int:plain")
        if kind in ("date", "uuid", "bytea"):
            out.append(kind)
        if kind == "boolean" or udt == "bool":
            out.append("bool")
        if udt in UDTS:
            out.append(f"udt:{udt}")
        if kind == "array" and self.array_dims == 1 and array_kind(self.udt):
            out.append("array")
        out += ["enum"] * bool(self.enum_values) + ["fk"] * bool(self.fk_target)
        return out


def norm_name(name: str) -> str:
    return name.lower().replace("_", "").replace("-", "")


@dataclass(frozen=True)
class Params:
    """Typed access with defaults; numbers interchange, a fraction is cut to an integer."""

    values: dict = field(default_factory=dict)

    def text(self, key: str, default: str) -> str:
        v = self.values.get(key)
        return v if isinstance(v, str) else default

    def int_(self, key: str, default: int) -> int:
        v = self.values.get(key)
        return int(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else default

    def float_(self, key: str, default: float) -> float:
        v = self.values.get(key)
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else default


Make = Callable[[Dialect, Params, Column], str]


@dataclass(frozen=True)
class Rule:
    """Scores a column of the family whose name (lower-cased, or normalised too) holds ``pattern`` but not ``unless``."""

    score: int
    family: str
    pattern: str = ""
    unless: str = ""
    normal: bool = False

    def __call__(self, column: Column, families: list[str]) -> int:
        name = norm_name(column.name) if self.normal else column.name.lower()
        hit = self.family in families and re.search(self.pattern, name) and not (self.unless and re.search(self.unless, name))
        return self.score if hit else NO_MATCH


@dataclass(frozen=True)
class Factory:
    """A generator. ``expr`` gives SQL text; ``kind`` is the Spark type of its values. Without rules
    (None) name and tags are matched against any column."""

    name: str
    rules: tuple[Rule, ...] | Callable[[Column], int] | None
    expr: Make
    kind: str = "string"
    tags: tuple = ()
    unique_per_row: bool = False
    required: tuple = ()  # parameters that must be set: (name, kind)

    def score(self, column: Column) -> int:
        if callable(self.rules):
            return self.rules(column)
        if self.rules is None:
            return default_score(self.name, self.tags, column)
        families = column.families()
        return max((r(column, families) for r in self.rules), default=NO_MATCH)


def default_score(name: str, tags, column: Column) -> int:
    own = norm_name(column.name)
    if own == norm_name(name):
        return STRONG
    return NAME if any(norm_name(t) in own for t in tags) else NO_MATCH


def _text(name: str, tags) -> tuple[Rule, ...]:
    """The name itself, or any of the tags within it, normalised, of a text column."""
    named = (Rule(NAME, "text", "|".join(re.escape(norm_name(t)) for t in tags), normal=True),) if tags else ()
    return (Rule(STRONG, "text", f"^{re.escape(norm_name(name))}$", normal=True), *named)


def _of(score: int, *families: str, like: str = "") -> tuple[Rule, ...]:
    return tuple(Rule(score, f, like) for f in families)


def _words(*words: str) -> str:
    """Any of the words between underscores or ends."""
    return rf"(^|_)({'|'.join(words)})(_|$)"


def array_kind(udt: str) -> str | None:
    raw = udt.lower().removeprefix("_")
    return next((k for k, names in ARRAY_KINDS.items() if raw in names), None)


_ENUM_LIKE = r"(^|_)(status|type)(_|$)"


def _range(lo: int, hi: int) -> Make:
    return lambda d, p, c: d.between(p.int_("min", lo), p.int_("max", hi))


def _int_max(c: Column) -> int:
    return 32_767 if c.data_type.lower() in ("smallint", "int2") else 1_000_000


def uuid_text(d: Dialect, draw: str | int = 0) -> str:
    m = d.hex(draw)
    variant = d.sub("'89ab'", f"CAST(1 + {d.h(draw)} % 4 AS INT)", 1)
    return d.cat(d.sub(m, 1, 8), "'-'", d.sub(m, 9, 4), "'-4'", d.sub(m, 14, 3), "'-'", variant, d.sub(m, 18, 3), "'-'", d.sub(m, 21, 12))


def hex_text(d: Dialect, n: int) -> str:
    return d.sub(d.cat(*[d.hex(k) for k in range(max(1, -(-n // 32)))]), 1, max(0, n))


def _decimal(d: Dialect, p: Params, c: Column) -> str:
    lo, hi = p.float_("min", 0), p.float_("max", 10_000)
    precision = c.precision if c.precision is not None else p.int_("precision", 0)
    scale = max(0, c.scale if c.scale is not None else p.int_("scale", 0))
    if precision > 0:
        hi = min(hi, 10.0 ** (precision - scale) - 10.0**-scale)
        lo = min(lo, hi)
    return f"({d.double(lo)} + {d.unit()} * {d.double(hi - lo)})"


def _array(d: Dialect, p: Params, c: Column) -> str:
    kind, n = array_kind(p.text("element", "") or c.udt), p.int_("size", 3)
    if kind is None:
        return d.null("ARRAY<STRING>") if type(d) is Dialect else "NULL::VARCHAR[]"
    item, of = {
        "text": (lambda i: d.cat("'item_'", d.text(d.row), "'_'", d.text(i)), "STRING"),
        "int": (lambda i: d.between(0, 999, i), "BIGINT"),
        "numeric": (lambda i: f"({d.double(d.between(0, 99_999, i))} / {d.double(100)})", "DOUBLE"),
        "bool": (lambda i: f"({d.h(i)} % 2 = 1)", "BOOLEAN"),
        "uuid": (lambda i: uuid_text(d, i), "STRING"),
    }.get(kind, (lambda i: "'{}'", "STRING"))
    return d.array(n, item, of)


def array_type(p: Params, c: Column) -> str:
    kind = array_kind(p.text("element", "") or c.udt)
    return f"array<{ {'int': 'bigint', 'numeric': 'double', 'bool': 'boolean'}.get(kind, 'string')}>".replace(" ", "")


def _tstzrange(d: Dialect, p: Params, c: Column) -> str:
    start = f"({ANCHOR} - {d.between(0, 364, 0)} * {DAY})"
    end = f"({start} + {d.between(30, 364, 1)} * {DAY})"
    return d.cat("""'["'""", d.time_text(start, False), """'+00","'""", d.time_text(end, False), """'+00")'""")


def _hstore(d: Dialect, p: Params, c: Column) -> str:
    pairs = [d.cat("""'"'""", d.pick(HSTORE_KEYS, 2 * i), d.s(f'_{i}"=>"'), d.text(d.between(0, 99, 2 * i + 1)), """'"'""") for i in range(max(1, p.int_("pairs", 2)))]
    return d.cat(*[x for i, pair in enumerate(pairs) for x in ([d.s(",")] if i else []) + [pair]])


def _localized(d: Dialect, p: Params, c: Column) -> str:
    import json

    parts = []
    for i, locale in enumerate(p.text("locales", "ru,en").split(",")):
        lead = ("," if i else "{") + json.dumps(locale.strip(), ensure_ascii=False) + ":" + json.dumps(c.name, ensure_ascii=False)[:-1] + " "
        parts += [d.s(lead), d.text(d.row), """'"'"""]
    return d.cat(*parts, "'}'")


def _enum(d: Dialect, p: Params, c: Column) -> str:
    values = p.values.get("values") or list(c.enum_values)
    if not values:
        return d.null()
    return d.pick(values) if any(isinstance(v, str) for v in values) else d.pick(values, text=False)


def _pool(values) -> Make:
    return lambda d, p, c: d.pick(values)


def _minutes(d: Dialect, p: Params, c: Column) -> str:
    m = d.between(30, 749)
    return d.cat(d.pad(f"CAST(floor({m} / 60) AS BIGINT)", 2), "':'", d.pad(f"({m} % 60)", 2), "':00'")


def _point(d: Dialect, p: Params, c: Column) -> str:
    return d.cat("'('", d.fmt("%.6f", d.scaled(-90, 90, 6, 0)), "','", d.fmt("%.6f", d.scaled(-180, 180, 6, 1)), "')'")


def _row(d: Dialect) -> str:
    return d.text(d.row)


def _factories() -> list[Factory]:
    def text(name, expr, tags=(), unique=False, kind="string"):
        return Factory(name, _text(name, tags), expr, kind, tags, unique)

    def whole(name, lo, hi, tags, like):
        return Factory(name, _of(NAME, "int", like=like), _range(lo, hi), "bigint", tags)

    year = 365 * DAY
    return [
        Factory("fkref", _of(FK, "fk"), lambda d, p, c: d.null(), tags=("fk",)),
        text("first_name", _pool(FIRST_NAMES), ("given_name", "fname")),
        text("last_name", _pool(LAST_NAMES), ("family_name", "surname", "lname")),
        Factory("full_name", _of(STRONG, "text", like="^(full|display)_?name$"), lambda d, p, c: d.cat(d.pick(FIRST_NAMES, 0), "' '", d.pick(LAST_NAMES, 1)), tags=("display_name",)),
        text("patronymic", _pool(PATRONYMICS), ("patronymic", "middle_name", "otchestvo")),
        text("email", lambda d, p, c: d.cat("'user'", _row(d), "'_'", d.text(d.between(0, 9_999)), d.s("@" + p.text("domain", "example.com"))), ("e_mail", "email_address"), True),
        text("phone", lambda d, p, c: d.cat(d.pick(DIAL_CODES, 0), d.pad(d.between(0, 99_999_999, 1), 8)), ("tel", "mobile", "phone_number")),
        text("url", lambda d, p, c: d.cat("'https://example.com/'", _row(d)), ("link", "website", "homepage", "url")),
        text("image_url", lambda d, p, c: d.cat("'https://picsum.photos/seed/'", _row(d), d.s(f"/{p.int_('width', 200)}/{p.int_('height', 200)}")), ("image", "logo", "avatar", "icon", "photo", "logotype", "preview")),
        text("company", _pool(COMPANIES), ("organisation", "organization", "employer", "company_name")),
        text("city", _pool(CITIES), ("town", "locality", "city_name")),
        text("country", _pool(COUNTRIES), ("country_code", "country_name")),
        text("hostname", lambda d, p, c: d.cat("'tenant-'", _row(d), "'.example.'", d.pick(TLDS)), ("hostname", "domain", "subdomain", "host"), True),
        text("slug", lambda d, p, c: d.cat(d.pick(SLUG_WORDS, 0), "'-'", d.pick(SLUG_WORDS, 1), "'-'", _row(d)), ("slug",), True),
        Factory("color", (Rule(NAME, "text", "colou?r", normal=True),), lambda d, p, c: d.fmt("#%06X", d.between(0, 0xFFFFFF)), tags=("color", "colour")),
        text("title", lambda d, p, c: d.cat(d.pick(TITLE_ADJECTIVES, 0), "' '", d.pick(TITLE_NOUNS, 1), "' '", _row(d)), ("title", "headline", "heading", "caption", "subject")),
        text("gender", lambda d, p, c: f"CASE WHEN {d.row} % 2 = 0 THEN 'male' ELSE 'female' END", ("gender", "sex")),
        text("token", lambda d, p, c: hex_text(d, p.int_("length", 32)), ("token", "api_key", "secret", "access_token", "auth_token")),
        Factory("ip_address", (Rule(TYPE, "udt:inet"), *_text("ip_address", ("ip", "ip_address", "ipaddr"))), lambda d, p, c: d.cat("'10.'", d.text(d.between(0, 255, 0)), "'.'", d.text(d.between(0, 255, 1)), "'.'", d.text(d.between(1, 254, 2))), tags=("ip", "ip_address", "ipaddr")),
        Factory("filename", _of(NAME, "text", like="file.?name"), lambda d, p, c: d.cat("'file_'", _row(d), "'.'", d.pick(EXTENSIONS)), tags=("file_name", "filename")),
        text("mime_type", _pool(MIME_TYPES), ("content_type", "mime_type", "media_type")),
        text("username", lambda d, p, c: d.cat(d.pick(USER_ADJECTIVES), "'_user_'", _row(d)), ("username", "user_name", "login", "login_name"), True),
        text("currency", _pool(CURRENCIES), ("currency", "currency_code")),
        text("language_code", _pool(LANGUAGES), ("language", "locale", "lang")),
        Factory("enum_value", _of(STRONG, "enum"), _enum, tags=("enum",), required=(("values", "list"),)),
        Factory("EnumValueStr", _of(NAME, "text", like="(^|_)(type|status)$"), _enum, tags=("type", "status"), required=(("values", "list"),)),
        Factory("pk_serial", _of(STRONG, "int", like="^id$"), lambda d, p, c: d.int_(f"({p.int_('start', 1)} + {d.row})"), "bigint", ("pk",), True),
        Factory("uuid", _of(STRONG, "uuid"), lambda d, p, c: uuid_text(d), unique_per_row=True),
        whole("position", 1, 100, ("position", "order", "sort_order", "rank"), _words("position", "sort_order")),
        whole("version_int", 1, 50, ("version", "revision"), _words("version", "revision")),
        whole("level", 1, 10, ("level", "tier", "grade"), _words("level", "tier")),
        whole("year", 2015, 2026, ("year",), _words("year")),
        whole("priority", 1, 10, ("priority",), _words("priority")),
        whole("percentage", 0, 100, ("score", "percent", "progress", "rating", "grade"), _words("score", "percent", "progress", "rating", "grade")),
        Factory("duration", _of(NAME, "int", "numeric", like=_words("duration", "time_spent", "elapsed")), _range(0, 7_200), "bigint", ("duration", "time_spent", "elapsed")),
        whole("file_size", 1_024, 52_428_800, ("file_size", "filesize"), "file.?size|byte.?size"),
        whole("counter", 0, 100, ("count",), "_count$"),
        Factory("amount", tuple(Rule(NAME, f, "amount|price|cost|fee|balance", normal=True) for f in ("int", "numeric")), lambda d, p, c: d.scaled(p.float_("min", 0), p.float_("max", 9_999.99), 2), "double", ("amount", "price", "cost", "fee", "balance")),
        whole("port", 1_024, 65_535, ("port",), _words("port")),
        Factory("status_code", _of(NAME, "int", like=_words("status_code", "http_code", "http_status")), lambda d, p, c: d.pick(HTTP_CODES, text=False), "int", ("status_code", "http_code", "http_status")),
        text("checksum", lambda d, p, c: hex_text(d, 40), ("checksum", "digest", "hash", "fingerprint")),
        Factory("version_str", _of(NAME, "text", like=_words("version")), lambda d, p, c: d.cat(d.text(d.between(0, 4, 0)), "'.'", d.text(d.between(0, 19, 1)), "'.'", d.text(d.between(0, 99, 2))), tags=("version", "semver", "app_version")),
        Factory("latitude", _of(NAME, "numeric", like="(^|_)lat(itude)?(_|$)"), lambda d, p, c: d.scaled(-90, 90, 6), "double", ("latitude", "lat")),
        Factory("longitude", _of(NAME, "numeric", like="(^|_)lo?n(gitude)?(_|$)"), lambda d, p, c: d.scaled(-180, 180, 6), "double", ("longitude", "lon", "lng")),
        Factory("integer", (Rule(WEAK_NAME, "int:plain", unless=_ENUM_LIKE), Rule(TYPE, "int")), lambda d, p, c: d.between(p.int_("min", 0), p.int_("max", _int_max(c))), "bigint", ("numeric",)),
        Factory("decimal", _of(WEAK_NAME, "numeric"), _decimal, "double", ("numeric",)),
        Factory("bool", _of(WEAK_NAME, "bool"), lambda d, p, c: f"({d.h()} % 2 = 1)", "boolean", ("logic",)),
        Factory("bytea", _of(STRONG, "bytea"), lambda d, p, c: d.bytes_(hex_text(d, 2 * p.int_("size", 16))), "binary"),
        Factory("array", _of(STRONG, "array"), _array, "array"),
        Factory("timestamp", (Rule(WEAK_NAME, "stamp", "_(at|on|date|time)$|^(deadline|applied)$"), Rule(TYPE, "stamp")), lambda d, p, c: d.timestamp(f"({ANCHOR} + {d.h()} % {year})"), "timestamp", ("time",)),
        Factory("date", _of(WEAK_NAME, "date"), lambda d, p, c: d.date(f"({ANCHOR_DAYS} + {d.h()} % 1825)"), "date", ("time",)),
        Factory("timestamp_str", _of(NAME, "text", like="_time$"), lambda d, p, c: d.cat(d.time_text(f"({ANCHOR} + {d.h()} % {year})", True), "'+00:00'"), tags=("created_time", "updated_time")),
        Factory("point", _of(TYPE, "udt:point"), _point, tags=("coordinates", "coordinate", "point", "location")),
        Factory("time_of_day", _of(TYPE, "udt:time", "udt:timetz"), lambda d, p, c: d.cat(d.pad(d.between(0, 23, 0), 2), "':'", d.pad(d.between(0, 59, 1), 2), "':'", d.pad(d.between(0, 59, 2), 2)), tags=("time",)),
        Factory("pg_interval", _of(TYPE, "udt:interval"), _minutes, tags=("interval", "duration")),
        Factory("tstzrange", _of(TYPE, "udt:tstzrange"), _tstzrange, tags=("validity", "valid_period", "period", "range")),
        Factory("hstore", _of(WEAK_NAME, "udt:hstore"), _hstore, tags=("hstore",)),
        Factory("localized_json", _of(NAME, "json", like="|".join(LOCALIZED)), _localized),
        Factory("string", _of(WEAK, "text"), lambda d, p, c: d.cat(d.s(c.name + "_"), _row(d)), tags=("text",), unique_per_row=True),
        Factory("json_any", _of(TYPE, "json"), lambda d, p, c: d.cat("""'{"row":'""", _row(d), "'}'"), tags=("json",)),
    ]


class Registry:
    """Factories by name; the first registration of a name stays, built-in ones come first."""

    def __init__(self, extra=()):
        self.all: list[Factory] = []
        self.by_name: dict[str, Factory] = {}
        for f in [*_factories(), *extra]:
            self.register(f)

    def register(self, factory: Factory) -> bool:
        if factory.name in self.by_name:
            return False
        self.by_name[factory.name] = factory
        self.all.append(factory)
        return True

    def get(self, name: str) -> Factory | None:
        return self.by_name.get(name)

    def infer(self, column: Column) -> tuple[Factory | None, int, bool]:
        """Best factory, its score, and whether that leaves the column unresolved."""
        best, score = None, NO_MATCH
        for f in self.all:
            if (s := f.score(column)) > score:
                best, score = f, s
        return best, score, best is None or score < WEAK_NAME

    def ranked(self, column: Column, top: int | None = 8) -> list[tuple[str, int]]:
        """Candidates by score, then name."""
        found = sorted(((f.score(column), f.name) for f in self.all if f.score(column) > 0), key=lambda x: (-x[0], x[1]))
        return [(n, s) for s, n in found[:top]]


def value_sql(d: Dialect, factory: Factory, params: dict[str, Any] | None = None, column: Column | None = None) -> str:
    """The expression, cut to ``max_len`` code points if the parameters say so."""
    p, c = Params(params or {}), column or Column(name=d.column)
    sql = factory.expr(d, p, c)
    n = p.int_("max_len", 0)
    return d.sub(sql, 1, n) if n > 0 and factory.kind == "string" else sql

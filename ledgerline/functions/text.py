"""Text expressions: headers, notes, channels, file names, mail subjects."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline import fixed
from ledgerline.functions.scalars import any_of, blank_to_null, case_of, col, num_of

_WORD_START, _WORD_END = "(?:^|[^A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def header_norm(c) -> Column:
    """Lower case without whitespace or zero-width blanks."""
    return F.lower(F.regexp_replace(col(c), r"[\s\u200B\u00A0\uFEFF]", ""))


def note_hints(c) -> Column:
    """struct(entitled, excess) read from a free-text note."""
    c = col(c)
    grab = lambda p: num_of(F.regexp_extract(c, p, 1))
    return F.struct(grab(fixed.NOTE_ENTITLED).alias("entitled"), grab(fixed.NOTE_EXCESS).alias("excess"))


def pipe_split(c) -> Column:
    """``left | right`` pair; missing parts are empty."""
    parts = F.split(F.coalesce(col(c), F.lit("")), r"\|")
    piece = lambda i: F.trim(F.coalesce(F.get(parts, F.lit(i)), F.lit("")))
    return F.struct(piece(0).alias("left"), piece(1).alias("right"))


def channel_of(c) -> Column:
    """``terminal : channel`` split on the last colon; the terminal may be a bank account."""
    v = F.trim(F.coalesce(col(c), F.lit("")))
    has_colon = v.contains(":")
    tail = F.substring_index(v, ":", -1)
    terminal = F.trim(F.when(has_colon, F.regexp_replace(v, r"(?s):[^:]*$", "")).otherwise(v))
    named = F.upper(F.trim(F.when(has_colon, tail).otherwise("")))
    return F.struct(terminal.alias("terminal"),
                    F.when(named != "", named).otherwise(F.upper(terminal)).alias("channel"),
                    terminal.rlike(r"^\d{9,15}$").alias("is_bank_account"))


def canonical_pm(c) -> Column:
    """Canonical gateway of a free-text channel; NULL when it is none."""
    s = F.regexp_replace(F.upper(F.coalesce(col(c), F.lit(""))), "[^A-Z0-9]", "")
    return case_of([(s.rlike(p), name) for p, name in fixed.CANONICAL_PM])


def company_of(name) -> Column:
    return blank_to_null(F.regexp_extract(col(name), _WORD_START + r"([A-Z]{2,4}\d{0,2})" + _WORD_END, 1))


def pm_provider_of(name) -> Column:
    s = F.lower(col(name))
    return case_of([(s.contains(k), v) for k, v in fixed.PM_PROVIDERS])


def subco_of(name, title) -> Column:
    """Sub-company: the title row without its brand prefix, else a short token of the file name."""
    t = F.upper(F.trim(F.regexp_replace(F.coalesce(col(title), F.lit("")), fixed.SUBCO_BRAND_PREFIX, "")))
    return F.when(t != "", t).otherwise(
        F.regexp_extract(col(name), _WORD_START + "([0-9]?[A-Z]{1,3}[0-9]?)" + _WORD_END, 1))


def ok_status(c) -> Column:
    """A blank status passes; otherwise it must contain one of the success words."""
    v = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    return (v == "") | any_of([v.contains(w) for w in fixed.OK_STATUS])


def is_manual(flag, via, channel) -> Column:
    text = F.concat_ws(" ", F.coalesce(col(via), F.lit("")), F.coalesce(col(channel), F.lit("")))
    return F.coalesce(col(flag), F.lit(False)) | text.rlike("(?i)มือ|manual")


# ------------------------------------------------------------------------------------ file kinds
def _ci(token: str) -> str:
    return f"(?i)(^|[^A-Za-z0-9]){token}([^A-Za-z0-9]|$)"


def file_kind(name) -> Column:
    """Kind given at ingest from the file name alone."""
    n = F.coalesce(col(name), F.lit(""))
    return case_of(
        [(n.rlike(fixed.PDF_NAME) & n.rlike(fixed.STM_NAME), "stm_pdf"), (n.rlike(fixed.PDF_NAME), "doc_clarify"),
         (n.rlike(fixed.DOC_NAME), "doc_clarify")]
        + [(n.rlike(p), kind) for p, kind in fixed.INGEST_KINDS], F.lit("unknown"))


def file_kind_on_write(name, kind) -> Column:
    """Kind repaired when a file row is written."""
    n, k = col(name), col(kind)
    return (F.when(n.rlike(fixed.PDF_NAME) & n.rlike(fixed.STM_NAME), "stm_pdf")
            .when((k == "unknown") & n.rlike(fixed.TRIGGER_PM_NAME), "pm_statement").otherwise(k))


def effective_kind(name, kind) -> Column:
    """Kind used by the completeness check."""
    n, k = col(name), col(kind)
    return (F.when(n.rlike(fixed.PDF_NAME) & n.rlike(fixed.STM_NAME), "stm_pdf")
            .when(k.isNotNull() & (k != "unknown"), k)
            .when(n.rlike(fixed.EFFECTIVE_PM_NAME), "pm_statement")
            .when(n.rlike(fixed.PDF_NAME), "stm_pdf")
            .when(n.rlike(fixed.BO_NAME), "bo_main")
            .otherwise("unknown"))


def fix_historic_kind(name, kind) -> Column:
    """Re-label past rows: misspelt gateways first, then back-office reports stored under another kind."""
    n, k = col(name), col(kind)
    gateway = F.when((k == "unknown") & n.rlike(fixed.FIX_PM_NAME), "pm_statement").otherwise(k)
    return F.when(n.rlike(fixed.BO_NAME) & ~gateway.eqNullSafe(F.lit("bo_main")), "bo_main").otherwise(gateway)


def kind_side(kind, side) -> Column:
    """A known file kind overrides the detected side."""
    k = col(kind)
    return case_of([(k == name, s) for name, s in fixed.KIND_SIDE.items()], col(side))


def file_company(name, current=None) -> Column:
    """Company token of a file name, in order; the current value is kept when none is found."""
    n = col(name)
    pairs = []
    for token, company in fixed.FILE_COMPANIES:
        hit = n.rlike(_ci(token))
        pairs.append((n.rlike(fixed.FILE_COMPANY_BRAND) | hit if company == "UFABET7M" else hit, company))
    pairs.append((n.rlike(fixed.FILE_COMPANY_SYS123), "SYS123"))
    return case_of(pairs, F.lit(None).cast("string") if current is None else col(current))


def parse_subject(subject) -> Column:
    """struct(company, business_date ISO text, is_supplement) of a mail subject."""
    s = F.coalesce(col(subject), F.lit(""))
    listed = case_of([(s.rlike(f"(?i){_WORD_START}{c}{_WORD_END}"), c) for c in fixed.SUBJECT_COMPANIES])
    company = F.coalesce(listed, company_of(s))
    found = F.regexp_extract_all(s, F.lit(r"(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"), F.lit(1))
    piece = lambda x, i: F.element_at(F.split(x, "[-/]"), i).try_cast("int")
    valid = F.filter(found, lambda x: piece(x, 1).between(1, 31) & piece(x, 2).between(1, 12))
    first = F.get(valid, F.lit(0))
    y = piece(first, 3)
    full = F.when(y < 100, y + 2500).otherwise(y)
    year = F.when(full > 2400, full - 543).otherwise(full)
    date = F.when(first.isNotNull(), F.concat_ws(
        "-", year.cast("string"), F.lpad(piece(first, 2).cast("string"), 2, "0"),
        F.lpad(F.element_at(F.split(first, "[-/]"), 1), 2, "0")))
    return F.struct(company.alias("company"), date.alias("business_date"),
                    s.contains(fixed.SUPPLEMENT_WORD).alias("is_supplement"))


def sender_email(sender) -> Column:
    return F.lower(blank_to_null(F.regexp_extract(F.coalesce(col(sender), F.lit("")), f"({fixed.EMAIL_PATTERN})", 1)))


def eligible_file(name, kind) -> Column:
    """Files a run can read: known extension, not a clarification document."""
    return col(name).rlike(fixed.READABLE_EXT) & ~F.coalesce(col(kind) == "doc_clarify", F.lit(False))


def ingestible_entry(path) -> Column:
    """Archive entries worth keeping: known extension, no operating-system junk."""
    return col(path).rlike(fixed.INGEST_EXT) & ~col(path).rlike(fixed.OS_JUNK)


def same_company(a, b) -> Column:
    upper = lambda c: F.upper(F.coalesce(col(c), F.lit("")))
    return upper(a) == upper(b)


def ascii_storage_key(date, company, message_id, ordinal, name) -> Column:
    """date/company/message/ordinal.ext with every unsafe character replaced."""
    safe = lambda c: F.regexp_replace(c, "[^A-Za-z0-9._-]", "_")
    ext = F.lower(F.coalesce(blank_to_null(F.regexp_extract(col(name), r"\.([A-Za-z0-9]{1,10})$", 1)), F.lit("bin")))
    o = col(ordinal).cast("string")
    padded = F.when(F.length(o) >= 3, o).otherwise(F.lpad(o, 3, "0"))
    or_ = lambda c, d: F.coalesce(blank_to_null(c), F.lit(d))
    return F.concat_ws("/", safe(or_(col(date).cast("string"), "unknown-date")), safe(or_(company, "UNKNOWN")),
                       safe(or_(col(message_id).cast("string"), "unknown-message")), F.concat(safe(padded), F.lit("."), ext))


def size_bytes(c) -> Column:
    """"1.2 MB" to bytes."""
    p = r"(?i)([\d.]+)\s*(B|kB|MB|GB)?"
    v = F.regexp_extract(col(c), p, 1).try_cast("double")
    u = F.lower(F.regexp_extract(col(c), p, 2))
    factor = F.when(u == "kb", 1024).when(u == "mb", 1048576).when(u == "gb", 1073741824).otherwise(1)
    return F.floor(v * factor + 0.5).cast("bigint")


# ------------------------------------------------------------------------------------ registry names
def normalize_account(c, bank) -> Column:
    """Digits only; a nine-digit wallet number gets its leading zero back."""
    d = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\D", "")
    return F.when((F.length(d) == 9) & F.coalesce(col(bank) == "TMN", F.lit(False)), F.concat(F.lit("0"), d)).otherwise(d)


def name_norm(c) -> Column:
    """Lower case without the tone and silencing marks that file names tend to lose."""
    return F.lower(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[\u0E47-\u0E4E]", ""))


def name_tokens(c) -> Column:
    return F.filter(F.split(F.regexp_replace(name_norm(c), r"[._/\\()\-]", " "), r"\s+"), lambda t: t != "")


def name_words(c) -> Column:
    """Words of a holder name, honorifics removed, at least two characters."""
    bare = F.transform(F.split(F.coalesce(col(c), F.lit("")), r"\s+"), lambda w: F.regexp_replace(w, fixed.HONORIFIC, ""))
    return F.filter(bare, lambda w: F.length(w) >= 2)


def direction_of_name(c) -> Column:
    n = name_norm(c)
    dep, wit = n.contains("ฝาก"), n.contains("ถอน")
    return F.when(dep & wit, "both").when(dep, "deposit").when(wit, "withdraw")


def _keyword(c, table: dict[str, str]) -> Column:
    """First token that is a keyword, else the first keyword of three or more letters inside the name."""
    mapping = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    hits = F.filter(F.transform(name_tokens(c), lambda t: F.try_element_at(mapping, t)), lambda v: v.isNotNull())
    raw = name_norm(c)
    inside = case_of([(raw.contains(k), v) for k, v in table.items() if len(k) >= 3])
    return F.coalesce(F.get(hits, F.lit(0)), inside)


def bank_from_name(c) -> Column:
    return _keyword(c, fixed.BANK_KEYWORDS)


def provider_from_name(c) -> Column:
    return _keyword(c, fixed.PM_KEYWORDS)

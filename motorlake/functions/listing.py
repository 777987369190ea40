"""Column expressions over single fields of listings, alerts, subscriptions and invites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest kilometres that a listing's text is believed to give.
KM_MOST = 2_000_000
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _path(url: Column) -> Column:
    """The path of an address, null where there is no scheme and host."""
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)", 1), F.lit(""))


def path_text(url: Column) -> Column:
    """The path as words: decoded, separators as spaces; null where it can't be decoded."""
    decoded = F.try_url_decode(F.replace(_path(url), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "[/_.+-]", " ")


def seller_title(url: Column) -> Column:
    """The segment of the path with most hyphens, the last of several, without its ending; null below two hyphens."""
    segments = F.transform(F.filter(F.split(_path(url), "/"), lambda s: s != ""), lambda s: F.regexp_replace(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), r"(?i)\.[a-z0-9]+$", ""))
    ranked = F.transform(segments, lambda s, i: F.struct((F.length(s) - F.length(F.replace(s, F.lit("-"), F.lit("")))).alias("hyphens"), i.alias("place"), s.alias("text")))
    best = F.array_max(ranked)
    return F.when(best["hyphens"] >= 2, best["text"])


def km_in_text(text: Column) -> Column:
    """The first kilometres in a text: groups of thousands or up to seven digits on a word's border; implausible ones are null."""
    found = F.regexp_replace(F.regexp_extract(text, r"(?i)\b(\d{1,3}(?:[.\s]\d{3})+|\d{3,7})\s*km\b", 1), r"[.\s]", "").try_cast("bigint")
    return F.when(found.between(1, KM_MOST), found)


def capitalised(slug: Column) -> Column:
    """A capital at the start and behind hyphens and spaces."""
    parts = F.split(slug, r"(?<=[-\s])")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def family_label(make: Column, model: Column) -> Column:
    """A readable family; makes of up to three letters in capitals."""
    return F.concat(F.when(F.length(make) <= 3, F.upper(make)).otherwise(capitalised(make)), F.lit(" "), capitalised(model))


def clean_model(name: Column) -> Column:
    """A catalog model without what stands in brackets."""
    return F.trim(F.regexp_replace(name, r"\s*\([^)]*\)", ""))


def clean_version(name: Column) -> Column:
    """A catalog version without chassis codes in front; the name itself where nothing would be left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(name, r"(?i)^(?:[a-z]{1,2}\d{1,3}[a-z]?\s+)+", "")), F.lit("")), name)


def photo(url: Column) -> Column:
    """A photo's address, https only, small previews of one size asked for larger."""
    return F.when(url.startswith("https://"), F.regexp_replace(url, r"/250x188\.webp$", "/640x480.webp"))


def created_at(identifier: Column) -> Column:
    """The time in the first twelve digits of an id, YYMMDDHHMMSS; null where they aren't one."""
    return F.when(F.length(identifier) >= 12, F.try_to_timestamp(F.concat(F.lit("20"), F.substring(identifier, 1, 12)), F.lit("yyyyMMddHHmmss")))


#: What a payment status means; "active" depends on whether it was cancelled.
STATUSES = {"trialing": "trial", "past_due": "em_atraso", "unpaid": "em_atraso", "canceled": "cancelada", "incomplete": "expirada", "incomplete_expired": "expirada"}


def subscription_status(status: Column, cancelled: Column) -> Column:
    """The state of a subscription by its payment status; null for unknown ones."""
    known = F.element_at(F.create_map(*[F.lit(x) for pair in STATUSES.items() for x in pair]), status)
    return F.when(status == "active", F.when(cancelled, "cancelada").otherwise("ativa")).otherwise(known)


def effective_status(state: Column, period_end: Column, now: Column) -> Column:
    """The state that holds now: expired once the period has ended."""
    return F.when((state == "expirada") | F.coalesce(period_end <= now, F.lit(False)), "expirada").otherwise(state)


def has_access(state: Column) -> Column:
    return state != "expirada"


def invite_state(status: Column, expires: Column, now: Column) -> Column:
    """What an invite shows: accepted, cancelled, expired or pending; not there for a null status."""
    return F.when(status.isNull(), "inexistente").when(status == "accepted", "aceite").when(status != "pending", "cancelado").when(expires <= now, "expirado").otherwise("pendente")


def freshness(seen: Column, now: Column) -> Column:
    """Days since a listing was seen, in words."""
    days = F.date_diff(now.cast("date"), seen.cast("date"))
    return F.when(days <= 0, "hoje").when(days == 1, "ontem").otherwise(F.concat(F.lit("há "), days.cast("string"), F.lit(" dias")))


def is_uuid(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(UUID), F.lit(False))

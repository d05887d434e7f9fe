"""Backends tried in order: choice, first success, credentials, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR_HEAD = "# 错误"
AUTH_WORDS = ("auth", "token", "401", "403", "quota", "limit")
FINAL_STATUS = (400, 401, 403, 404, 410, 422)
RETRY_STATUS = (429, 500, 502, 503, 504)


def chain(file_type: Column, explicit: Column, pdf_chain: Column) -> Column:
    """Backends for a file: the one asked for; for PDFs the configured chain, or local; for images the OCR; else local."""
    given = F.nullif(F.trim(F.coalesce(explicit, F.lit(""))), F.lit(""))
    pdf = F.when(F.coalesce(F.size(pdf_chain), F.lit(0)) > 0, pdf_chain).otherwise(F.array(F.lit("local")))
    return F.when(given.isNotNull() & (given != "auto"), F.array(given)).when(file_type == "pdf", pdf).when(file_type == "image", F.array(F.lit("paddleocr"))).otherwise(F.array(F.lit("local")))


def succeeded(markdown: Column, media: Column) -> Column:
    """Whether a result counts: text that is no error page, or any medium."""
    text = F.coalesce(markdown, F.lit(""))
    return ((text != "") & ~text.startswith(ERROR_HEAD)) | (F.coalesce(F.size(media), F.lit(0)) > 0)


def first_success(attempts: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Per key: the backend of the first attempt that succeeded (null if none), its place, whether it was in the chain, and the
    failures before it, 'backend: reason', in order. One aggregation."""
    good = F.col("ok") & F.col("backend").isNotNull()
    out = attempts.groupBy(key).agg(
        F.min_by(F.struct("backend", order), F.when(good, F.col(order))).alias("_w"),
        F.array_sort(F.collect_list(F.when(~F.coalesce("ok", F.lit(False)), F.struct(F.col(order), F.col("backend"), F.col("reason"))))).alias("_f"),
        F.max_by("backend", order).alias("last_backend"),
    )
    before = F.filter("_f", lambda f: F.col(f"_w.{order}").isNull() | (f[order] < F.col(f"_w.{order}")))
    lines = F.transform(before, lambda f: F.concat(F.coalesce(f["backend"], F.lit("?")), F.lit(": "), F.coalesce(f["reason"], F.lit(""))))
    used = F.when(F.col(f"_w.{order}").isNotNull(), F.col("_w.backend"))
    return out.select(key, used.alias("used_backend"), F.col(f"_w.{order}").alias("used_ord"), used.isNotNull().alias("in_chain"), lines.alias("failures"))


def cascade(rows: DataFrame, key: str, backends: list) -> DataFrame:
    """Run backends, functions of a DataFrame that give (key, markdown, media), one after the other, each only on the rows
    that none before it solved. Results are staged between tiers, so that no backend is asked twice."""
    from ..session import staged

    done, rest = None, rows
    for k, (name, run) in enumerate(backends):
        tried = staged(run(rest).select(key, "markdown", "media", F.lit(name).alias("used_backend"), F.lit(k + 1).alias("used_ord")), f"tier{k}")
        good = tried.where(succeeded(F.col("markdown"), F.col("media")))
        done = good if done is None else done.unionByName(good)
        rest = rest.join(good.select(key), key, "left_anti")
    failed = rest.select(key, F.lit(None).cast("string").alias("markdown"), F.lit(None).cast("array<string>").alias("media"), F.lit(None).cast("string").alias("used_backend"), F.lit(None).cast("int").alias("used_ord"))
    return failed if done is None else done.unionByName(failed)


def auth_error(message: Column) -> Column:
    """Whether a failure has to do with the credential, so that the next one should be tried."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.lit(False) if not AUTH_WORDS else m.rlike("|".join(AUTH_WORDS))


def retryable(status: Column) -> Column:
    """True for overload and server errors, false for final client errors, null for what is returned as it is."""
    return F.when(status.isin(*RETRY_STATUS), True).when(status.isin(*FINAL_STATUS), False)


def backoff_ms(status: Column, attempt: Column, base_ms: int = 1000) -> Column:
    """Wait before the next try after attempt (from 0): 8 s doubling when asked to slow down, base doubling after server errors,
    half of that after network failures (null status)."""
    return F.when(status == 429, 8000 * F.pow(F.lit(2.0), attempt)).when(status >= 500, base_ms * F.pow(F.lit(2.0), attempt)).when(status.isNull(), base_ms * F.pow(F.lit(2.0), attempt - 1)).cast("bigint")


def failover(outcomes: DataFrame, group: str, order: str, credential: str, ok: str, reason: str) -> DataFrame:
    """Per group, over outcomes in order: how many credentials are out (an attempt failed with an authorisation error and none
    later marks it good), how many are left of those seen, and the first that worked."""
    bad = ~F.coalesce(F.col(ok), F.lit(False)) & auth_error(F.col(reason))
    per = outcomes.groupBy(group, credential).agg(F.max(bad).alias("_bad"), F.min(F.when(F.col(ok), F.col(order))).alias("_ok"))
    return per.groupBy(group).agg(F.count("*").alias("total"), F.count(F.when(F.col("_bad"), 1)).alias("failed"), F.count(F.when(~F.col("_bad"), 1)).alias("available"), F.min_by(credential, F.when(~F.col("_bad"), F.col("_ok"))).alias("first_good"))


def next_credential(credentials: Column, failed: Column, cursor: Column) -> Column:
    """Round robin: the first credential at or after the cursor (from 0) that has not failed; null if all have."""
    n = F.size(credentials)
    turned = F.concat(F.slice(credentials, cursor % n + 1, n), F.slice(credentials, F.lit(1), cursor % n))
    return F.get(F.filter(turned, lambda c: ~F.array_contains(failed, c)), F.lit(0))


def legacy_provider(wanted: Column, office: Column, program: Column) -> Column:
    """Which converter takes old formats: the one named, by any of its names; with auto the installed office (office says
    whether there is one), else the program if its path is set; null if there is none."""
    w = F.lower(F.trim(F.coalesce(wanted, F.lit("auto"))))
    path = F.coalesce(F.trim(program), F.lit("")) != ""
    named = F.when(w.isin("com", "office", "office-com", "msoffice"), "office").when(w.isin("libreoffice", "soffice", "lo"), "libreoffice")
    return F.coalesce(named, F.when(F.coalesce(office, F.lit(False)), "office").when(path, "libreoffice"))


def within_limits(pages: Column, size_bytes: Column, has_token: Column) -> Column:
    """Why a PDF is refused by the cloud service, null if it is not: 10 MB and 20 pages without a token, 200 and 200 with one."""
    mb, most = F.when(has_token, 200).otherwise(10), F.when(has_token, 200).otherwise(20)
    return F.when(size_bytes > mb * 1048576, "too large").when(pages > most, "too many pages")


def token_status(service: Column, status: Column, code: Column) -> Column:
    """valid, invalid, expired or error, from a probe's answer."""
    mineru = F.when(code == "A0211", "expired").when((code == "A0202") | (status == 401), "invalid").when(status == 200, "valid")
    paddle = F.when(status.isin(200, 400), "valid").when(status.isin(401, 403), "invalid")
    return F.coalesce(F.when(service == "mineru", mineru).otherwise(paddle), F.lit("error"))


def pool(file_type: Column, backends: Column) -> Column:
    """legacy for formats that must be converted, local if only that backend is asked, else api."""
    return F.when(file_type.isin("doc", "xls", "ppt"), "legacy").when(F.forall(backends, lambda b: b == "local"), "local").otherwise("api")

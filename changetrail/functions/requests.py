"""Column functions that normalise one raw web request or command run."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from changetrail import fixed_values as fixed


def page_name(path: Column) -> Column:
    """Last component of a path."""
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def client_ip(forwarded: Column, proxy_forwarded: Column, remote: Column) -> Column:
    """First address that is set; a proxy list is kept as it came."""
    return F.coalesce(forwarded, proxy_forwarded, remote, F.lit(""))


def whole_seconds(time: Column) -> Column:
    """Cut a zone-less timestamp to the second without a trip through the session zone."""
    return time - F.make_dt_interval(secs=F.date_part(F.lit("SECOND"), time) % 1)


def time_text(time: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``, for zone-less times without a trip through the session zone."""
    return F.substring(time.cast("string"), 1, 19)


def utc_now() -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())


def _script_has(script: Column, *names: str) -> Column:
    return reduce(or_, [script.contains(name) for name in names])


def is_admitted(script: Column, req_action: Column, mode: Column, has_post: Column,
                purge_continue: Column) -> Column:
    """Whether a web request can change state. The first rule that matches the path decides."""
    return (F.when(_script_has(script, fixed.NEVER_LOGGED_SCRIPT), False)
            .when(_script_has(script, fixed.USER_ADMIN_SCRIPT)
                  & (req_action == fixed.PASSWORD_CHECK_ACTION), False)
            .when(_script_has(script, fixed.PLUGINS_SCRIPT), mode.isNotNull())
            .when(_script_has(script, *fixed.SELF_SERVICE_SCRIPTS), False)
            .when(has_post, True)
            .otherwise(F.coalesce(purge_continue, F.lit(False))))


def preset_action(script: Column, mode: Column, has_post: Column) -> Column:
    """Action an *admitted* request gets from the rule that admitted it, or NULL."""
    return (F.when(_script_has(script, fixed.PLUGINS_SCRIPT), mode)
            .when(~F.coalesce(has_post, F.lit(False)), fixed.PURGE_ACTION))


def is_foreground_command(argv0: Column) -> Column:
    """Whether a command was started by a person, not by the polling machinery."""
    return reduce(and_, [~argv0.contains(mark) for mark in fixed.BACKGROUND_SCRIPT_MARKS])


def classify_action(page: Column, drp_action: Column, has_items: Column, preset: Column,
                    req_action: Column) -> Column:
    """Name of the action. Page-specific names need selected items, delete and disable do not."""
    code = drp_action.try_cast("int")
    chain = F
    for on_page, names in ((fixed.DEVICE_PAGE, fixed.DEVICE_ACTIONS),
                           (fixed.HOST_PAGE, fixed.HOST_ACTIONS)):
        for number, name in names.items():
            chain = chain.when(has_items & (page == on_page) & (code == number), name)
    for number, name in fixed.BULK_ACTIONS.items():
        chain = chain.when(code == number, name)
    given = F.nullif(F.nullif(preset, F.lit("")), F.lit("0"))
    return chain.otherwise(F.coalesce(given, req_action, F.lit(fixed.ACTION_NONE)))


def upper_first(text: Column) -> Column:
    """Only the first letter in upper case; ``initcap`` would change every word."""
    return F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))

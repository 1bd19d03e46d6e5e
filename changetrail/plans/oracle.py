"""The same results in SQL for DuckDB, over views of the given tables."""

from __future__ import annotations

from changetrail.plans.fixtures import (COMMANDS, ITEM_PAGES, MIXED_JSON, MORE_KEYS, NESTED_LIST,
                                        ORDERED_KEYS, SCRIPTS, TEXT_LIKE_ENTRIES)


def _pick(index: str, values: tuple[str, ...]) -> str:
    cases = " ".join(f"when {i} then '{value}'" for i, value in enumerate(values))
    return f"case {index} {cases} end"


LOG = """select event_id as id, concat(event_type, '.php') as page,
    events.user_id + case when events.user_id % 7 = 3 then 1000000000 else 0 end as user_id,
    case when events.user_id = 0 then 'cli' else event_type end as action,
    concat('10.0.0.', cast(events.user_id % 256 as varchar)) as ip_address,
    concat('agent-', cast(events.user_id % 7 as varchar)) as user_agent,
    ts as event_time, props as post from events"""

USERS = "select c_custkey as id, c_name as username from customer"

REQUESTS = f"""select o_orderkey as req_id, o_custkey as custkey,
    case when o_custkey % 11 <> 0 then o_custkey
        + case when o_custkey % 7 = 3 then 1000000000 else 0 end else 0 end as user_id,
    timestamp '2024-01-01 00:00:00' + cast(o_orderkey % 28 as integer) * interval 1 day
        + cast(o_orderkey % 86400 as integer) * interval 1 second as event_time,
    concat('/srv/app/', {_pick('o_orderkey % 10', SCRIPTS)}) as script_name,
    {_pick('o_orderkey % 10', SCRIPTS)} as page,
    o_totalprice < 300000 as has_post,
    case when o_custkey % 5 = 0 then '1.1.1.1' when o_custkey % 4 = 0 then '2.2.2.2'
         when o_custkey % 3 = 0 then '3.3.3.3' else '' end as ip_address,
    concat('agent-', cast(o_custkey % 7 as varchar)) as user_agent,
    o_orderstatus as status,
    case o_orderstatus when 'F' then 'checkpass' when 'O' then 'save' end as req_action,
    case when o_custkey % 2 = 0 then 'install' end as mode_arg,
    case when (o_orderkey // 10) % 6 <> 0 then (o_orderkey // 10) % 6 - 1 end as code,
    o_custkey % 3 = 0 as purge_continue,
    (o_orderkey // 60) % 4 <> 0 as has_items,
    concat('{{"id":"', o_orderkey, '","items":["', o_custkey, '","7"],"status":"',
           o_orderstatus, '"}}') as post
    from orders"""

ADMITTED = """select *, case when page = 'plugins.php' then mode_arg
        when not has_post then 'purge' end as preset
    from requests
    where case when page in ('graph_view.php', 'auth_profile.php', 'index.php',
                             'auth_changepassword.php') then false
          when page = 'user_admin.php' and req_action = 'checkpass' then false
          when page = 'plugins.php' then mode_arg is not null
          else has_post or purge_continue end"""

CLASSIFIED = """select *, case
    when page = 'automation_devices.php' and has_items and code = 2 then 'Delete Device'
    when page = 'automation_devices.php' and has_items and code = 1 then 'Create Device'
    when page = 'host.php' and has_items and code = 2 then 'Host Enabled'
    when page = 'host.php' and has_items and code = 3 then 'Host Disabled'
    when code = 1 then 'delete' when code = 4 then 'disable'
    else coalesce(preset, req_action, 'none') end as action from admitted"""

CLI = f"""select * from (select event_id, {_pick('event_id % 6', COMMANDS)} as script,
    concat('--id=', cast(user_id as varchar)) as arg1, event_type as arg2,
    concat('10.1.0.', cast(user_id % 256 as varchar)) as host_ip,
    concat('os-', cast(user_id % 5 as varchar)) as os_user, ts as event_time from events)
    where script = '/a/cli/add.php'"""

CLI_ROWS = """select event_id * 2 + 1 as id, 'add.php' as page, cast(0 as bigint) as user_id,
    'cli' as action, host_ip as ip_address, os_user as user_agent,
    date_trunc('second', event_time) as event_time,
    concat(script, ' ', arg1, ' ', arg2) as post, cast(null as varchar) as object_data
    from cli"""


def _rows(page: str, source: str, key: str, fields: str, where: str = "true") -> str:
    return (f"select '{page}' as page, {key} as item, "
            f"cast(json_object({fields}) as varchar) as row_text "
            f"from {source} where {where}")


ENTITY_ROWS = " union all ".join([
    _rows("host.php", "part", "p_partkey",
          "'host_id', p_partkey, 'site_id', p_size, 'description', p_name, 'hostname', p_brand,"
          " 'status', p_partkey % 4, 'last_failed_date',"
          " case when p_partkey % 3 <> 0 then '2024-01-02 03:04:05' end,"
          " 'last_recovered_date', '0000-00-00 00:00:00'"),
    _rows("host_templates.php", "part", "p_partkey", "'name', p_name"),
    _rows("templates_export.php", "part", "p_partkey", "'name', p_type"),
    _rows("automation_devices.php", "part", "p_partkey",
          "'id', p_partkey, 'network_id', p_size, 'hostname', p_brand, 'ip',"
          " concat('10.2.0.', cast(p_partkey % 256 as varchar)), 'sysName', p_name,"
          " 'syslocation', case when p_partkey % 5 <> 0 then p_type end,"
          " 'snmp', case when p_partkey % 3 = 1 then 'UP' else 'Down' end,"
          " 'up', case when p_partkey % 2 = 1 then 'Yes' else 'No' end"),
    _rows("graph_templates.php", "part", "p_partkey", "'name', p_type"),
    _rows("thold.php", "part", "p_partkey",
          "'id', p_partkey, 'THOLD_NAME', p_name, 'Data_Source', p_brand"),
    _rows("data_sources.php", "part", "p_partkey",
          "'Data_Source_Name', p_name, 'active', 'on'"),
    _rows("data_sources.php", "part", "p_partkey",
          "'Data_Source_Name', p_brand, 'active', ''", "p_partkey % 2 = 1"),
    _rows("data_templates.php", "supplier", "s_suppkey", "'name', s_name"),
    _rows("aggregate_templates.php", "part", "p_partkey", "'name', p_name"),
    _rows("thold_templates.php", "part", "p_partkey", "'name', p_brand"),
    _rows("user_admin.php", "customer", "c_custkey", "'username', c_name"),
    _rows("user_group_admin.php", "customer", "c_custkey", "'name', c_mktsegment"),
])

ITEMS = """select event_id, position,
    key + case when key % 10 = 0 then 1000000000 else 0 end as item
    from (select o_orderkey as event_id, position,
        o_custkey + (o_orderkey + position * position) % 5 as key
        from orders, unnest(range(0, o_orderkey % 8)) as places(position))"""

# Expects a CTE `events_with_page(event_id, page)`.
SNAPSHOT = f"""
entity as (select page, item, concat('[', string_agg(row_text, ',' order by row_text), ']')
    as rows_text from ({ENTITY_ROWS}) group by page, item),
items as ({ITEMS}),
records as (select e.event_id, i.position, coalesce(n.rows_text, '[]') as record
    from events_with_page e join items i on e.event_id = i.event_id
    left join entity n on n.page = e.page and n.item = i.item
    where e.page in (select page from entity)),
objects as (select event_id, concat('[', string_agg(record, ',' order by position), ']')
    as object_data from records group by event_id)"""

# The same with every row laid out over lines: a field's JSON behind its quoted name.
PRETTY_SNAPSHOT = SNAPSHOT.replace(
    "concat('[', string_agg(row_text, ',' order by row_text), ']')",
    """concat(chr(91), chr(10), string_agg(concat('    {', chr(10), array_to_string(list_transform(
        json_keys(row_text), lambda k: concat('        "', k, '": ',
        json_extract(row_text, concat('$."', k, '"')))), concat(',', chr(10))), chr(10), '    }'),
        concat(',', chr(10)) order by row_text), chr(10), chr(93))""")

THREE_PAGES = """select o_orderkey as event_id, case o_orderstatus when 'F' then 'host.php'
    when 'O' then 'data_templates.php' else 'user_admin.php' end as page from orders"""
ALL_PAGES = (f"select o_orderkey as event_id, {_pick('o_orderkey % 13', ITEM_PAGES)} as page "
             "from orders")

SNAPSHOT_RESULT = """select e.event_id, coalesce(o.object_data, '[]') as object_data
    from events_with_page e left join objects o on e.event_id = o.event_id"""

WEB_EVENTS = f"""with requests as ({REQUESTS}), admitted as ({ADMITTED}),
classified as ({CLASSIFIED}),
events_with_page as (select req_id as event_id, page from admitted where has_items), {SNAPSHOT},
web as (select c.req_id * 2 as id, c.page, c.user_id, c.action, c.ip_address, c.user_agent,
    c.event_time, c.post, coalesce(o.object_data, '[]') as object_data
    from classified c left join objects o on c.req_id = o.event_id)"""

# Requests as they come: what steers them stands in the parameters only.
FORM = f"""kinds as (select *, (req_id // 8) % 10 as kind from ({REQUESTS})),
form_items as (select i.event_id, i.position, i.item from ({ITEMS}) i
    join kinds on req_id = event_id where kind >= 4
    union all select req_id, 0, custkey from kinds where kind = 3),
form_texts as (select event_id, concat('a:', count(*), ':{{', string_agg(concat('i:', position,
        ';s:', length(item::varchar), ':"', item, '";'), '' order by position), '}}') as serialized,
    concat('["', string_agg(item::varchar, '","' order by position), '"]') as listed
    from form_items group by event_id),
requests as (select k.* exclude (post, has_items), k.has_items and kind > 2 as has_items,
    k.has_items as sent_items,
    concat('{{"id":"', req_id, '"', 
        case when req_action is not null then concat(',"action":"', req_action, '"') else '' end,
        case when mode_arg is not null then concat(',"mode":"', mode_arg, '"') else '' end,
        case when code is not null then concat(',"drp_action":"', code, '"') else '' end,
        case when purge_continue then ',"purge_continue":"1"' else '' end,
        case when k.has_items then concat(',"selected_items":"', replace(case kind
            when 0 then '{NESTED_LIST}' when 1 then '{TEXT_LIKE_ENTRIES}' when 2 then '{MIXED_JSON}'
            when 3 then concat('a:1:{{s:3:"é1";i:', custkey, ';}}')
            when 4 then coalesce(t.listed, '[]') else coalesce(t.serialized, 'a:0:{{}}') end,
            '"', '\\"'), '"') else '' end,
        ',"items":["', custkey, '","7"],"status":"', status, '"}}') as post
    from kinds k left join form_texts t on k.req_id = t.event_id)"""

RAW_WEB = f"""with {FORM}, admitted as ({ADMITTED}), classified as ({CLASSIFIED}),
events_with_page as (select req_id as event_id, page from admitted where has_items),
{SNAPSHOT.replace(f"items as ({ITEMS})", "items as (select * from form_items)")},
web as (select c.req_id * 2 as id, c.page, c.user_id, c.action, c.ip_address, c.user_agent,
    c.event_time, c.post, coalesce(o.object_data, '[]') as object_data
    from classified c left join objects o on c.req_id = o.event_id),
raw_commands as (select req_id, custkey, event_time, {_pick('req_id % 6', COMMANDS)} as script
    from requests where req_id % 4 = 0 and req_id not in (select req_id from admitted)),
routed as (select * from web union all select req_id * 2 + 1, 'add.php', 0, 'cli', '10.3.0.1',
    concat('os-', custkey % 5), event_time, concat(script, ' --id=', custkey), null
    from raw_commands where script = '/a/cli/add.php')"""
IS_BROKEN = "req_id % 50 = 7"


MIXED_PAGES = (("event_time", 30, 3), ("event_time", 1200, 1), ("page", 40, 2), ("username", 600, 1))
MIXED = f"""{WEB_EVENTS}, cli as ({CLI}), log as (select * from web union all ({CLI_ROWS})),
users as ({USERS})"""


def _log(sql: str) -> str:
    return f"with log as ({LOG}), users as ({USERS}) {sql}"


def _requests(sql: str) -> str:
    return (f"with requests as ({REQUESTS}), admitted as ({ADMITTED}), "
            f"classified as ({CLASSIFIED}), users as ({USERS}) {sql}")


NAMED = "select log.*, username from log left join users on log.user_id = users.id"
TEXT_TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"
LOG_TIME = TEXT_TIME.format("event_time")
SEARCH_R = "where (page like '%r%' or post like '%r%')"
EXPORT = f"""select page, user_id, username, action, ip_address, user_agent,
    {LOG_TIME} as event_time"""
REQUEST_EXPORT = _requests(f"""
    select page, user_id, username, coalesce(req_action, 'none') as action, ip_address,
    user_agent, {LOG_TIME} as event_time,
    concat('id:', req_id, '|items:', custkey, '%7|status:', status) as post
    from (select * exclude (req_action, post), case
        when page = 'automation_devices.php' and has_items and code = 2 then 'Delete Device'
        when page = 'automation_devices.php' and has_items and code = 1 then 'Create Device'
        when page = 'host.php' and has_items and code = 2 then 'Host Enabled'
        when page = 'host.php' and has_items and code = 3 then 'Host Disabled'
        when code = 1 then 'delete' when code = 4 then 'disable'
        else req_action end as req_action from requests) r
    left join users on r.user_id = users.id""")
CUTOFF = "timestamp '2024-01-31 00:00:00' - interval 14 days"

ORACLE: dict[str, str] = {
    "list_events": _log(f"{NAMED} {SEARCH_R} order by event_time desc, log.id desc limit 30"),
    "list_second_page": _log(
        f"{NAMED} {SEARCH_R} order by event_time desc, log.id desc limit 30 offset 30"),
    "list_by_username_asc": _log(
        f"{NAMED} order by username asc nulls first, log.id asc limit 200 offset 400"),
    "list_deep_page": _log(f"{NAMED} order by page asc, log.id asc limit 70 offset 560"),
    "list_stored_page": _log(f"""select log.* exclude (event_time), event_time,
        cast(null as varchar) as object_data, username
        from log left join users on log.user_id = users.id
        where page like '%i%' or post like '%i%'
        order by event_time desc, log.id desc limit 40 offset 240"""),
    "search_events": _log("select * from log where page like '%e_ro%' or post like '%e_ro%'"),
    "search_literal": _log(
        "select * from log where contains(page, '5}') or contains(post, '5}')"),
    "search_ignore_case": _log(
        "select * from log where page ilike '%IEW.p%' or post like '%IEW.p%'"),
    "search_signed": _log(f"""select needle, log.*, cast(null as varchar) as object_data from log,
        (values ('click%7', '%click%7%'), ('k\\.php', '%k.php%'), ('e', '%e%'), ('purchase', '%purchase%'),
            ('"k": 5%', '%"k": 5%'), ('no such text', '%no such text%'), ('8_}}', '%8_}}%'), ('sig', '%sig%'),
            ('', '%')) needles(needle, pattern)
        where (event_time >= {CUTOFF} or event_time is null)
            and (page like pattern or post like pattern)"""),
    "filter_page": _log("select * from log where page = 'click.php'"),
    "filter_user": _log("select * from log where user_id = 7"),
    "filter_cli": _log("select * from log where user_id = 0"),
    "filter_all": _log("""select * from log where (page like '%1%' or post like '%1%')
        and page = 'view.php' and user_id = 8"""),
    "event_by_id": _log("select * from log where id = 500"),
    "count_events": _log(f"""select count(*) as events from log
        left join users on log.user_id = users.id {SEARCH_R}"""),
    "page_facet": _log("select distinct page from log order by page"),
    "user_facet": _log("""select user_id, username from
        (select distinct user_id from log where user_id <> 0) seen
        left join users on seen.user_id = users.id order by user_id"""),
    "with_username": _log(NAMED),
    "with_username_read": _log(NAMED),
    "with_username_shuffled": _log(NAMED),
    "display_view": _log(f"""select log.id, page,
        case when action = 'cli' then user_agent else username end as user_name,
        concat(upper(action[1]), action[2:]) as action,
        case when action = 'cli' then 'N/A' else user_agent end as user_agent, ip_address,
        {LOG_TIME} as event_time from log left join users on log.user_id = users.id"""),
    "event_header": _log(f"""select log.id, page,
        case when action = 'cli' then user_agent else username end as user_name, ip_address,
        {LOG_TIME} as event_time, action from log left join users on log.user_id = users.id"""),
    "cli_detail": _log(f"""select id, page, user_agent as user_name, ip_address,
        {LOG_TIME} as event_time, action, post as script from log where action = 'cli'"""),
    "event_attributes": _requests("""
        select req_id as id, 1 as position, 'id' as attribute, cast(req_id as varchar) as value,
            false as wide from requests
        union all select req_id, 2, 'items', concat(custkey, ',7'), false from requests
        union all select req_id, 3, 'status', status, false from requests"""),
    "attribute_order": f"""select o_orderkey as id, cast(position as integer) as position, attribute,
            concat(attribute, o_orderkey) as value, o_orderkey % 5 = 0 as wide
        from orders, (values {", ".join(f"({i}, '{name}')" for i, name in
                                        enumerate(ORDERED_KEYS + MORE_KEYS, 1))}) names(position, attribute)
        where o_orderkey % 5 = 0 or position <= {len(ORDERED_KEYS)}""",
    "event_objects_pretty": f"""with events_with_page as ({ALL_PAGES}), {PRETTY_SNAPSHOT}
        select event_id as id, cast(position as integer) as position, record from records""",
    "event_objects": f"""with events_with_page as ({THREE_PAGES}), {SNAPSHOT}
        select event_id as id, cast(position as integer) as position, record from records""",
    "export_events": REQUEST_EXPORT,
    "export_filtered": _log(f"""{EXPORT}, replace(replace(replace(post, '{{"', ''), '": ', ':'),
        '}}', '') as post from log left join users on log.user_id = users.id
        where (page like '%k%' or post like '%k%') and page = 'purchase.php'"""),
    "export_lines": f"""select concat(page, ', ', user_id, ', ', coalesce(username, ''), ', ',
        action, ', ', ip_address, ', ', user_agent, ', ', event_time, ', ', post) as line
        from ({REQUEST_EXPORT}) union all
        select 'page, user_id, username, action, ip_address, user_agent, event_time, post'
        where exists (select 1 from orders)""",
    "export_csv": _log(f"""{EXPORT}, replace(replace(replace(post, '{{"', ''), '": ', ':'),
        '}}', '') as post from log left join users on log.user_id = users.id"""),
    "export_escaped": _requests(f"""select {", ".join(
            f"""replace(replace(cast({name} as varchar), '"', ''), ',', '|') as {name}"""
            for name in ("page", "user_id", "username", "action", "ip_address", "user_agent",
                         "event_time", "post"))} from ({REQUEST_EXPORT})"""),
    "flatten_post": _requests("""select req_id, concat('id:', req_id, '|items:', custkey,
        '%7|login_password:x|PassPhrase:y|header:false|__csrf_magic:z|status:', status) as flat
        from requests"""),
    "request_fields": f"""with {FORM}, item_texts as (select event_id,
            string_agg(item, ',' order by position) as items from form_items group by event_id)
        select req_id, req_action, mode_arg, cast(code as varchar) as drp_action, purge_continue,
            has_items, case when has_items then coalesce(items, '') end as items
        from requests left join item_texts on req_id = event_id""",
    "admit_requests": _requests(
        "select req_id, script_name, preset as preset_action from admitted"),
    "classify_action": _requests("select req_id, action from classified"),
    "normalise_requests": _requests("""select req_id as id, page, user_id, action, ip_address,
        user_agent, event_time, post from classified"""),
    "client_ip": _requests("select req_id, ip_address from requests"),
    "page_name": _requests(
        "select req_id, regexp_replace(script_name, '^.*/', '') as page from requests"),
    "admit_cli": f"with cli as ({CLI}) select event_id, script from cli",
    "normalise_cli": f"with cli as ({CLI}) {CLI_ROWS}",
    "route_events": _requests("""select req_id, 'web' as route from admitted union all
        select req_id, 'cli' from requests where req_id % 4 = 0
        and req_id not in (select req_id from admitted)"""),
    "redact_params": _requests("""
        select req_id, 'id' as param, concat('"', req_id, '"') as value from requests
        union all select req_id, 'items', concat('["', custkey, '","7"]') from requests
        union all select req_id, 'status', concat('"', status, '"') from requests"""),
    "encode_post": _requests("select req_id, post from requests"),
    "decode_selected_items": f"""with {FORM} select req_id, cast(code as varchar) as drp_action,
            cast(position as integer) as position, item
        from requests join form_items on req_id = event_id where has_items""",
    "snapshot_objects": f"with events_with_page as ({THREE_PAGES}), {SNAPSHOT} {SNAPSHOT_RESULT}",
    "snapshot_read_tables": f"with events_with_page as ({THREE_PAGES}), {SNAPSHOT} {SNAPSHOT_RESULT}",
    "snapshot_all_pages": f"with events_with_page as ({ALL_PAGES}), {SNAPSHOT} {SNAPSHOT_RESULT}",
    "snapshot_shuffled": f"with events_with_page as ({ALL_PAGES}), {SNAPSHOT} {SNAPSHOT_RESULT}",
    "device_flags": """select p_partkey as id,
        case when p_partkey % 3 = 1 then 'UP' else 'Down' end as snmp,
        case when p_partkey % 2 = 1 then 'Yes' else 'No' end as up
        from part""",
    "expire_events": _log(
        f"select * from log where event_time >= {CUTOFF} or event_time is null"),
    "purged_count": _log(f"select count(*) as purged from log where event_time < {CUTOFF}"),
    "expire_stored": _log(f"""select *, cast(null as varchar) as object_data from log
        where event_time >= {CUTOFF} or event_time is null"""),
    "append_after_expire": _log(f"""select *, cast(null as varchar) as object_data from log
        where event_time >= {CUTOFF} or event_time is null union all
        select * replace (id + 1000000000 as id), cast(null as varchar) from log"""),
    "append_after_purge": _log("select *, cast(null as varchar) as object_data from log"),
    "list_mixed_log": f"{MIXED} " + " union all ".join(
        f"""select * from (select '{sort} {rows}' as list, log.*, username
            from log left join users on log.user_id = users.id order by {sort} desc nulls last,
            log.id desc limit {rows} offset {rows * (page - 1)})"""
        for sort, rows, page in MIXED_PAGES),
    "event_by_id_mixed": f"{MIXED} select * from log where id in (1200, 1201)",
    "append_events": f"{WEB_EVENTS}, cli as ({CLI}) select * from web union all ({CLI_ROWS})",
    "ingest_stream": f"{WEB_EVENTS} select * from web",
    "web_events_raw": f"{RAW_WEB} select * from web",
    "route_raw": f"{RAW_WEB} select * from routed",
    "ingest_routed": f"{RAW_WEB} select * from routed",
    "whole_json_lines": f"""{RAW_WEB} select req_id, custkey % 11 <> 0 as has_user, page, post
        from requests where not ({IS_BROKEN})""",
    "broken_json_lines": f"""with requests as ({REQUESTS})
        select concat('{{"req_id":', req_id) as line from requests where {IS_BROKEN}""",
    "ingest_json_stream": f"""{RAW_WEB} select *, cast(null as varchar) as line from routed
        where (id // 2) % 50 <> 7 union all select null, null, null, null, null, null, null, null, null,
        concat('{{"req_id":', req_id) from requests where {IS_BROKEN}""",
    "live_view_stream": f"""{RAW_WEB}, users as ({USERS}) select routed.id, page,
        case when action = 'cli' then user_agent else username end as user_name,
        concat(upper(action[1]), action[2:]) as action,
        case when action = 'cli' then 'N/A' else user_agent end as user_agent, ip_address,
        {LOG_TIME} as event_time from routed left join users on routed.user_id = users.id""",
    "json_log_sink": f"""{WEB_EVENTS} select * exclude (id, event_time),
        {LOG_TIME} as event_time from web""",
    "evolve_schema": _log("select *, cast(null as varchar) as object_data from log"),
    "evolve_table": _log("select *, case when id % 2 = 1 then '[]' end as object_data from log"),
    "evolve_files": _log("select *, case when id % 2 = 1 then '[]' end as object_data from log"),
    "purge_notes": _log(f"""select 'bea' as actor, count(*) as events from log
        where event_time >= {CUTOFF} or event_time is null
        union all select 'admin', count(*) from log"""),
    "purge_all": "select count(*) as events_before, cast(0 as bigint) as events_after from events",
    "ensure_log": "select count(*) as events from events",
    "clone_schema": """select count(*) as events, cast(0 as bigint) as cloned_events,
        11 as columns from events""",
    "overlong_values": _log("""select count(*) filter (length(page) > 40) as page_over_40,
        count(*) filter (length(action) > 20) as action_over_20,
        count(*) filter (length(ip_address) > 40) as ip_address_over_40,
        count(*) filter (length(user_agent) > 256) as user_agent_over_256 from log"""),
}

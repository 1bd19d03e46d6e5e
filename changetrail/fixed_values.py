"""Values that stored logs and their readers depend on. They are data, kept in one place."""

# --- fixed values: request admission -------------------------------------------------
NEVER_LOGGED_SCRIPT = "graph_view.php"
USER_ADMIN_SCRIPT = "user_admin.php"
PASSWORD_CHECK_ACTION = "checkpass"
PLUGINS_SCRIPT = "plugins.php"
SELF_SERVICE_SCRIPTS = ("auth_profile.php", "index.php", "auth_changepassword.php")
PURGE_ACTION = "purge"
BACKGROUND_SCRIPT_MARKS = ("poller", "cmd.php", "/scripts/", "script_server.php", "_process.php")

# --- fixed values: redaction ---------------------------------------------------------
TRANSPORT_PARAMS = ("__csrf_magic", "header")
SECRET_PARAM_PATTERN = "(?i)pass|phrase"      # anywhere in the name

# --- fixed values: action names ------------------------------------------------------
ACTION_DELETE = "delete"
ACTION_DISABLE = "disable"
ACTION_NONE = "none"
ACTION_CLI = "cli"
DEVICE_PAGE = "automation_devices.php"
DEVICE_ACTIONS = {1: "Create Device", 2: "Delete Device"}
HOST_PAGE = "host.php"
HOST_ACTIONS = {2: "Host Enabled", 3: "Host Disabled"}
BULK_ACTIONS = {1: ACTION_DELETE, 4: ACTION_DISABLE}

# --- fixed values: log columns -------------------------------------------------------
LOG_COLUMNS = ("id", "page", "user_id", "action", "ip_address", "user_agent",
               "event_time", "post", "object_data")
JSON_LOG_FIELDS = ("page", "user_id", "action", "ip_address", "user_agent",
                   "event_time", "post", "object_data")
COLUMN_WIDTHS = {"page": 40, "action": 20, "ip_address": 40, "user_agent": 256}
SORTABLE_COLUMNS = ("page", "username", "action", "user_agent", "ip_address", "event_time")
EXPORT_HEADER = "page, user_id, username, action, ip_address, user_agent, event_time, post"
NOT_APPLICABLE = "N/A"
WIDE_DETAIL_ABOVE = 16

# --- fixed values: setting defaults --------------------------------------------------
DEFAULT_RETENTION_DAYS = 90
SECONDS_PER_DAY = 86400

# --- fixed values: what is looked up for the items selected on each page -------------
# page: (table, key, ((source column, output field), ...), key is unique)
ENTITY_LOOKUPS = {
    "host.php": ("host", "id", (
        ("id", "host_id"), ("site_id", "site_id"), ("description", "description"),
        ("hostname", "hostname"), ("status", "status"),
        ("status_fail_date", "last_failed_date"),
        ("status_rec_date", "last_recovered_date")), True),
    "host_templates.php": ("host_template", "id", (("name", "name"),), True),
    "templates_export.php": ("graph_templates", "id", (("name", "name"),), True),
    "automation_devices.php": ("automation_devices", "id", (
        ("id", "id"), ("network_id", "network_id"), ("hostname", "hostname"), ("ip", "ip"),
        ("sysName", "sysName"), ("syslocation", "syslocation"), ("snmp", "snmp"),
        ("up", "up")), True),
    "graph_templates.php": ("graph_templates", "id", (("name", "name"),), True),
    "thold.php": ("thold_data", "id", (
        ("id", "id"), ("name_cache", "THOLD_NAME"), ("data_source_name", "Data_Source")), True),
    "data_sources.php": ("data_template_data", "local_data_id", (
        ("name_cache", "Data_Source_Name"), ("active", "active")), False),
    "data_templates.php": ("data_template", "id", (("name", "name"),), True),
    "aggregate_templates.php": ("aggregate_graph_template", "id", (("name", "name"),), True),
    "thold_templates.php": ("thold_template", "id", (("name", "name"),), True),
    "user_admin.php": ("user_auth", "id", (("username", "username"),), True),
    "user_group_admin.php": ("user_auth_group", "id", (("name", "name"),), True),
}

"""Facts of a small code base that several tests use."""

import json


def fact(i, construct, file, line, end=None, derived=False, **fields):
    return i, construct, file, line, end or line, {k: v if isinstance(v, str) or v is None else json.dumps(v) for k, v in fields.items()}, derived, "high"


FACTS = [
    fact("F01", "express_mount", "server.js", 10, router_file="routes/videos.js", mount_path="/api/videos"),
    fact("F02", "express_mount", "server.js", 11, router_file="routes/users.js", mount_path="/api/users"),
    fact("F03", "express_route", "routes/videos.js", 5, 20, method="GET", router_path="/approved"),
    fact("F04", "express_route", "routes/videos.js", 25, 40, method="GET", router_path="/:id"),
    fact("F05", "express_route", "routes/users.js", 3, 9, method="POST", router_path="/"),
    fact("F06", "express_route", "routes/lost.js", 3, 9, method="GET", router_path="/"),
    fact("F07", "mongoose_model", "models/User.js", 9, model_name="User", schema_var="s"),
    fact("F08", "mongoose_model", "models/Video.js", 9, model_name="Video", schema_var="s"),
    fact("F09", "mongoose_schema", "models/Video.js", 1, schema_var="s", collection_option="clips"),
    fact("F10", "require_binding", "routes/users.js", 1, local_name="U", resolved_file="models/User.js"),
    fact("F11", "require_binding", "routes/videos.js", 1, local_name="V", resolved_file="models/Video.js"),
    fact("F12", "db_operation", "routes/users.js", 5, local_name="U", op="save", access="write", route_fact_id="F05"),
    fact("F13", "db_operation", "routes/videos.js", 7, local_name="V", op="find", access="read", route_fact_id="F03"),
    fact("F14", "db_operation", "routes/videos.js", 8, local_name="Z", op="find", access="read", route_fact_id="F03"),
    fact("F15", "fs_write", "middleware/up.js", 4, fs_path="@dirname/../uploads", mechanism="multer"),
    fact("F16", "require_binding", "routes/videos.js", 2, local_name="up", resolved_file="middleware/up.js"),
    fact("F17", "multer_use", "routes/videos.js", 26, uploader="up", field="image", route_fact_id="F04"),
    fact("F18", "http_client_config", "config.js", 1, base_url_branches=["http://a:1/api", "http://b/api/"]),
    fact("F19", "http_client_call", "app.js", 3, method="get", path_literal="/videos/approved"),
    fact("F20", "http_client_call", "app.js", 4, method="get", path_expr="`/videos/${id}`"),
    fact("F21", "role_check", "routes/videos.js", 6, roles=["parent", "child"], route_fact_id="F03"),
    fact("F22", "web_storage_access", "app.js", 9, store="localStorage", key="token", access="write"),
]

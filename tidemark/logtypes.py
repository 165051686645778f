"""Log-type codes. They are part of the collectors' wire format."""

from __future__ import annotations

# Page navigation.
WEB_START, WEB_RESPONSE, WEB_END, WEB_ERROR, SCRIPT_ERROR = 131073, 131074, 131075, 131076, 131077
RESOURCE_START, RESOURCE_END, WEB_CLICK = 131079, 131080, 131088
WEB_LOGIN, WEB_LOGOUT, WEB_LOADING_END, WEB_BIZ_ERROR, WEB_VITAL = 131106, 131107, 131108, 131109, 131110

# Network calls.
HTTP_REQUEST, HTTP_END, HTTP_RESPONSE, HTTP_ERROR, HTTP_EXCEPTION = 524289, 524290, 524291, 524292, 524293
AJAX_REQUEST, AJAX_SEND, AJAX_RESPONSE, AJAX_ERROR, AJAX_EXCEPTION = 8388610, 8388611, 8388612, 8388613, 8388614

# Native app.
NATIVE_START, NATIVE_END, NATIVE_ERROR, APP_START = 1048577, 1048578, 1048579, 1048580
APP_FOREGROUND, APP_BACKGROUND, APP_TERMINATE, DEEP_LINK, APP_NOT_RESPONDING = 1048581, 1048582, 1048583, 1048584, 1048585
NATIVE_PAGE_START, NATIVE_PAGE_END, NATIVE_BIZ_ERROR = 1048592, 1048593, 1048594
NATIVE_CLICK, INSTALL_REFERER, APP_FIRST_START = 1048595, 1048596, 1048597
CRASH = 2097152

# Custom tags.
TAG_COMMON, TAG_ERROR, TAG_ALARM = 4194305, 4194306, 4194307

# Sets used by the operators.
WATERFALL = (RESOURCE_START,)
WEBPERF = (RESOURCE_START, RESOURCE_END)
NETWORK = (AJAX_RESPONSE, AJAX_ERROR, HTTP_RESPONSE, HTTP_ERROR)
NETWORK_ERROR = (AJAX_ERROR, AJAX_EXCEPTION, HTTP_ERROR, HTTP_EXCEPTION)
ERROR = (WEB_ERROR, SCRIPT_ERROR, HTTP_ERROR, TAG_ERROR, NATIVE_ERROR, HTTP_EXCEPTION, AJAX_EXCEPTION, AJAX_ERROR)
FRONT_ERROR = (WEB_ERROR, SCRIPT_ERROR, TAG_ERROR, NATIVE_ERROR)
VITAL = (WEB_VITAL,)
ACCESS = (NATIVE_START, APP_START, WEB_START)
VISIT = (APP_START, WEB_LOGIN)
INSTALL_OR_START = (APP_FIRST_START, APP_START)
WEB_PAGE = (WEB_START, NATIVE_PAGE_START)
REPLAY = (
    WEB_START, NATIVE_PAGE_START, WEB_CLICK, APP_START, WEB_ERROR, SCRIPT_ERROR, TAG_ERROR, TAG_COMMON, NATIVE_ERROR,
)
NATIVE = (
    1048576, NATIVE_START, NATIVE_END, NATIVE_ERROR, APP_START, APP_FOREGROUND, APP_BACKGROUND, APP_TERMINATE,
    DEEP_LINK, APP_NOT_RESPONDING, NATIVE_PAGE_START, NATIVE_PAGE_END, CRASH,
)
# What the trouble table keeps: its own list, crash included, wider than ERROR.
TROUBLE = (
    CRASH, 65538, WEB_ERROR, SCRIPT_ERROR, WEB_BIZ_ERROR, 262148, HTTP_ERROR, AJAX_ERROR, NATIVE_ERROR, NATIVE_BIZ_ERROR,
)

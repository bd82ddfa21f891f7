"""Pages for the paged source: three pages of one edition, or one that changes."""

PAGES = {"": ("e1", "id,name\n1,a\n2,b\n", "p2"), "p2": ("e1", "id,name\n3,\n", "p3"), "p3": ("e1", 'id,name\n4,"d, e"\n', None)}


def fetch(cursor):
    return PAGES[cursor]


def fetch_changing(cursor):
    edition, text, following = PAGES[cursor]
    return ("e2" if cursor == "p3" else edition), text, following


def fetch_logged(cursor):
    """As fetch, for cursors `<log>|<cursor>`: each call is written down in the log; fails where <log>.fail names the cursor."""
    import os

    log, cursor = cursor.split("|")
    if os.path.exists(log + ".fail") and open(log + ".fail").read() == cursor:
        raise OSError("unreachable")
    with open(log, "a") as f:
        f.write(cursor + "|")
    edition, text, following = PAGES[cursor]
    return edition, text, following and f"{log}|{following}"

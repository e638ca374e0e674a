"""Fixed vocabularies of audit logs."""

# Operations whose subject and object change places.
REVERSED = (
    "EVENT_EXECUTE", "EVENT_LSEEK", "EVENT_MMAP", "EVENT_OPEN", "EVENT_ACCEPT", "EVENT_READ", "EVENT_RECVFROM",
    "EVENT_RECVMSG", "EVENT_READ_SOCKET_PARAMS", "EVENT_CHECK_FILE_ATTRIBUTES", "READ",
)

# Operations that never become edges.
EXCLUDED = ("EVENT_FCNTL", "EVENT_OTHER", "EVENT_ADD_OBJECT_ATTRIBUTE", "EVENT_FLOWS_TO")

# Operations that are kept, in the order of their ids from 1.
RELATIONS_CDM = (
    "EVENT_CONNECT", "EVENT_EXECUTE", "EVENT_OPEN", "EVENT_READ", "EVENT_RECVFROM", "EVENT_RECVMSG",
    "EVENT_SENDMSG", "EVENT_SENDTO", "EVENT_WRITE", "EVENT_CLONE",
)

# Operations between types of nodes.
ALLOWED_CDM = {
    ("subject", "subject"): ("EVENT_READ", "EVENT_WRITE", "EVENT_OPEN", "EVENT_CONNECT", "EVENT_RECVFROM", "EVENT_SENDTO", "EVENT_CLONE", "EVENT_SENDMSG", "EVENT_RECVMSG"),
    ("subject", "file"): ("EVENT_WRITE", "EVENT_CONNECT", "EVENT_SENDMSG", "EVENT_SENDTO", "EVENT_CLONE"),
    ("subject", "netflow"): ("EVENT_WRITE", "EVENT_SENDTO", "EVENT_CONNECT", "EVENT_SENDMSG"),
    ("file", "subject"): ("EVENT_READ", "EVENT_OPEN", "EVENT_RECVFROM", "EVENT_EXECUTE", "EVENT_RECVMSG"),
    ("netflow", "subject"): ("EVENT_OPEN", "EVENT_READ", "EVENT_RECVFROM", "EVENT_RECVMSG"),
}

# Substrings of labels of ordinary system objects.
BENIGN_KEYWORDS = (
    ":", "/dev/pts", "salt-minion.log", "null", "usr", "proc", "firefox", "tmp", "thunderbird", "bin/",
    "/data/replay_logdb", "/stat", "/boot", "qt-opensource-linux-x64", "/eraseme", "675",
)

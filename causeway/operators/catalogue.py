"""The rule catalogue as data: patterns, rules, and the closed lists that graph building uses (fixed values)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RULESET_VERSION = 6

SOURCES = {
    "environment": "os.environ os.getenv os.environb dotenv".split(),
    "sensitive_file": "~/.ssh ~/.aws ~/.netrc ~/.git-credentials ~/.config/gcloud ~/.docker/config.json ~/.kube ~/.pypirc ~/.bash_history ~/.mozilla ~/.config/google-chrome ~/AppData/Local/Google/Chrome ~/AppData/Roaming/discord ~/.electrum ~/.bitcoin /etc/passwd /etc/shadow .env".split(),
    "system_identity": "socket.gethostname socket.getfqdn platform getpass.getuser os.getlogin uuid.getnode os.getcwd os.uname".split(),
    "user_input": "pyperclip.paste pynput keyboard PIL.ImageGrab mss".split(),
    "network_response": "urllib.request.urlopen requests.get requests.post http.client socket.socket.recv urllib3 httpx urllib.request.urlretrieve urllib.urlretrieve wget.download".split(),
    "decoded_literal": ["<fold>"],
    "suspicious_literal": "<literal:url-not-index> <literal:command-with-url> <literal:raw-ip> <literal:shell-pipeline> <literal:wallet-address> <literal:home-or-root-path>".split(),
    "phase_root": ["<phase-root>"],
}

#: A trailing ``[0]`` marks sinks that only the first positional argument reaches.
SINKS = {
    "network_egress": "socket.socket.connect socket.socket.send socket.socket.sendall socket.create_connection urllib.request.urlopen urllib.request.Request http.client requests urllib3 httpx aiohttp discord.SyncWebhook discord.Webhook discord_webhook discordwebhook dhooks telebot.TeleBot telegram.Bot smtplib ftplib dns.resolver webbrowser.open".split(),
    "code_execution": "exec[0] eval[0] compile[0] subprocess[0] os.system[0] os.popen[0] os.exec os.spawn os.startfile[0] ctypes pty.spawn[0] marshal.loads[0] pickle.loads[0] <interpreter-stdin>".split(),
    "persistence_write": ["<write:~/.bashrc>", "<write:~/.zshrc>", "<write:~/.profile>", "<write:~/.config/autostart>", "<write:/etc/cron>", "<write:site-packages/*.pth>", "<write:sitecustomize.py>", "winreg.SetValueEx", "<write:~/AppData/Roaming/Microsoft/Windows/Start Menu/Programs/Startup>"],
    "destructive_fs": "shutil.rmtree[0] os.remove[0] os.unlink[0] pathlib.Path.unlink os.rmdir[0]".split(),
    "process_control": "os.dup2[0] pty.spawn".split(),
    "dynamic_import": "__import__[0] importlib.import_module[0]".split(),
}

#: rule, title, sources, sinks, path kind, severity, objective, typical phase, obfuscation technique, target, via, severity override.
RULES = [
    ("EXF-001", "environment values sent out", ["environment"], ["network_egress"], "data", "critical", "exfiltration", "install", False, "sink", None, False),
    ("EXF-002", "sensitive file sent out", ["sensitive_file"], ["network_egress"], "data", "critical", "exfiltration", "install", False, "sink", None, False),
    ("EXF-003", "system identity sent out", ["system_identity"], ["network_egress"], "data", "high", "exfiltration", "install", False, "sink", None, False),
    ("EXF-004", "user input sent out", ["user_input"], ["network_egress"], "data", "critical", "exfiltration", "runtime", False, "sink", None, False),
    ("DRP-001", "download executed", ["network_response"], ["code_execution"], "data", "critical", "dropper", "install", False, "sink", None, False),
    ("DRP-002", "download written and run", ["network_response"], ["code_execution"], "data", "critical", "dropper", "install", False, "sink", "file_write", False),
    ("DRP-003", "suspicious command run", ["suspicious_literal"], ["code_execution"], "data", "critical", "dropper", "install", False, "sink", None, False),
    ("OBF-001", "decoded constant executed", ["decoded_literal"], ["code_execution"], "data", "critical", "unknown", "install", True, "sink", None, False),
    ("OBF-002", "decoded constant imported", ["decoded_literal"], ["dynamic_import"], "data", "medium", "unknown", "import", True, "sink", None, False),
    ("BKD-001", "remote control of a process", ["suspicious_literal", "network_response"], ["process_control"], "data", "critical", "backdoor", "runtime", False, "sink", None, False),
    ("PER-001", "persistence written", ["network_response", "decoded_literal"], ["persistence_write"], "data", "high", "backdoor", "install", False, "sink", None, False),
    ("SAB-001", "files destroyed", ["sensitive_file", "suspicious_literal"], ["destructive_fs"], "data", "high", "denial_of_service", "install", False, "sink", None, False),
    ("INS-001", "network use at installation", ["phase_root"], ["network_egress"], "control", "high", "unknown", "install", False, "sink", None, False),
    ("INS-002", "code run at installation", ["phase_root"], ["code_execution"], "control", "medium", "unknown", "install", False, "sink", None, True),
    ("INS-003", "sensitive file read at installation", ["phase_root"], ["sensitive_file"], "control", "medium", "exfiltration", "install", False, "read", None, False),
]
RULE_FIELDS = "rule string, title string, sources array<string>, sinks array<string>, kind string, severity string, objective string, typical_phase string, technique_obfuscation boolean, target string, via string, severity_override boolean"

TAINT_PRESERVING = "str bytes bytearray repr format chr ord reversed list tuple dict set map filter zip enumerate sorted os.path pathlib urllib.parse re open io.open json".split()
TAINT_OBFUSCATING = "pickle marshal base64 binascii codecs zlib gzip bz2 lzma hashlib hmac cryptography Crypto Cryptodome nacl fernet".split()
PRESERVING_METHODS = frozenset("encode decode join split rsplit splitlines replace translate strip lstrip rstrip lower upper format format_map zfill ljust rjust center hex copy read readline readlines read_text read_bytes getvalue findall finditer search match fullmatch group groups groupdict fileno json iter_content iter_lines iter_bytes iter_text iter_raw get pop items keys values".split())
OBFUSCATING_METHODS = frozenset("encode decode".split())
RECEIVER_TAINTING = frozenset("write writelines send sendall sendto connect connect_ex append extend insert add update".split())
RECEIVER_LOADING = frozenset("read read_file read_string read_dict".split())
OPENERS = frozenset("open io.open".split())
PROCESS_STARTERS = frozenset("subprocess.Popen subprocess.run subprocess.call subprocess.check_call subprocess.check_output".split())
INTERPRETERS = frozenset("python pythonw py sh bash zsh dash powershell pwsh node perl ruby".split())
SCRIPT_FLAGS = frozenset("-c -m -e -Command -File".split())
DOWNLOADERS = {"urllib.request.urlretrieve": (1, "filename"), "urllib.urlretrieve": (1, "filename"), "wget.download": (1, "out")}
GUARD_NAMES = tuple("platform sys.platform os.name os.environ os.getenv os.uname os.getlogin socket.gethostname getpass locale datetime time".split())
DECODERS = tuple("chr base64.b64decode base64.standard_b64decode base64.urlsafe_b64decode base64.b32decode base64.b16decode base64.b85decode base64.a85decode base64.decodebytes binascii.unhexlify binascii.a2b_base64 binascii.a2b_hex bytes.fromhex codecs.decode zlib.decompress gzip.decompress bz2.decompress lzma.decompress".split())
SITE_DIRS = tuple("site.getsitepackages site.getusersitepackages site.USER_SITE sysconfig.get_path sysconfig.get_paths distutils.sysconfig.get_python_lib".split())
SEPARATOR_METHODS = tuple("replace split rsplit join strip lstrip rstrip startswith endswith partition rpartition count find rfind index rindex removeprefix removesuffix".split())
PATH_APIS = tuple("os.path pathlib posixpath ntpath".split())
CALLBACK_RUNNERS = {
    "threading.Thread": ("target", 1),
    "threading.Timer": ("function", 1),
    "multiprocessing.Process": ("target", 1),
    "atexit.register": ("func", 0),
    "signal.signal": ("handler", 1),
    "weakref.finalize": ("func", 1),
    "asyncio.to_thread": ("func", 0),
    "concurrent.futures.ThreadPoolExecutor.submit": ("fn", 0),
    "concurrent.futures.ProcessPoolExecutor.submit": ("fn", 0),
    "concurrent.futures.ThreadPoolExecutor.map": ("fn", 0),
    "concurrent.futures.ProcessPoolExecutor.map": ("fn", 0),
}
LOWERCASE_CONSTRUCTORS = frozenset("socket.socket socket.create_connection socket.socketpair socket.fromfd ssl.wrap_socket requests.session urllib.request.build_opener".split())
FACTORIES = {"discord.SyncWebhook.from_url": "discord.SyncWebhook", "discord.SyncWebhook.partial": "discord.SyncWebhook", "discord.Webhook.from_url": "discord.Webhook", "discord.Webhook.partial": "discord.Webhook"}


def is_under(name: str, prefix: str) -> bool:
    return name == prefix or name.startswith(prefix + ".")


def source_patterns() -> list[tuple[str, str, int]]:
    """kind, pattern, rank."""
    return [(k, p, n) for n, (k, p) in enumerate((k, p) for k, ps in SOURCES.items() for p in ps)]


def sink_patterns() -> list[tuple[str, str, bool, int]]:
    """kind, pattern, first argument only, rank."""
    flat = [(k, p) for k, ps in SINKS.items() for p in ps]
    return [(k, p.removesuffix("[0]"), p.endswith("[0]"), n) for n, (k, p) in enumerate(flat)]


def rules(spark: SparkSession) -> DataFrame:
    """E-15: the catalogue in order."""
    return spark.createDataFrame([(*r, k) for k, r in enumerate(RULES)], RULE_FIELDS + ", ord int")

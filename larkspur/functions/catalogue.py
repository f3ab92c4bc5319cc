"""Fixed values of the audit rules: codes, names, patterns and thresholds.

Everything here is data that results have to agree on; the logic that uses it
is elsewhere.  Confidences are 1 (very low) to 5 (very high).
"""

from __future__ import annotations

LEVELS = {"very_low": 1, "low": 2, "medium": 3, "high": 4, "very_high": 5}
LEVEL_NAMES = {v: k for k, v in LEVELS.items()}
LEVEL_ALIASES = {"verylow": 1, "med": 3, "mid": 3, "veryhigh": 5}

# Rules in order, as code, name, description, help.
RULES = [
    ("HX1000", "AppEnumeration", "Suspicious application enumeration.", None),
    ("HX1010", "BrowserEnumeration", "Suspicious browser enumeration (apps, cookies, history, etc.).", None),
    ("HX1020", "PathEnumeration", "Suspicious path enumeration.", None),
    ("HX1030", "OSFingerprint", "Suspicious OS fingerprinting.", "OS fingerprinting can be used to identify the target system and its vulnerabilities."),
    ("HX2000", "ClipboardRead", "Reading from the clipboard.", "Clipboard access can be used to exfiltrate sensitive data such as passwords and keys."),
    ("HX2010", "EnvAccess", "Access to a sensitive environment variable.", "Access to sensitive environment variables can be used to exfiltrate data."),
    ("HX2020", "ScreenshotCapture", "Capturing screenshots from the display.", "Screenshot capture can be used to steal sensitive information shown on screen."),
    ("HX3000", "CodeExec", "Possible code execution.", None),
    ("HX3010", "ShellExec", "Execution of a shell command.", None),
    ("HX3040", "DLLInjection", "Possible DLL injection.", None),
    ("HX3050", "DangerousExec", "Execution of potentially dangerous command inside a shell command.", "Dangerous commands can be used to download and execute malicious scripts."),
    ("HX3060", "SuspiciousCall", "Suspicious function call.", "Suspicious function call detected."),
    ("HX4000", "ObfuscatedShellExec", "Execution of possibly obfuscated shell command.", "Obfuscated shell commands can be used to bypass detection."),
    ("HX4010", "ObfuscatedCodeExec", "Execution of possibly obfuscated code.", "Obfuscated code exec can be used to bypass detection."),
    ("HX5000", "DunderImport", "Suspicious use of `__import__`.", "``__import__`` can be used to used to avoid detection of imports and code execution."),
    ("HX5010", "SuspiciousImport", "Suspicious import.", None),
    ("HX5020", "CtypesImport", "Suspicious ctypes import.", "`ctypes` module can be used to import DLLs and memory manipulation."),
    ("HX5030", "PickleImport", "Suspicious pickle import.", "`pickle` module can be used to execute arbitrary code when the data is deserialized."),
    ("HX5040", "StructImport", "Suspicious struct import.", "`struct` module can be used to craft malicious payloads or shellcode."),
    ("HX5050", "SocketImport", "Suspicious socket import.", "`socket` module can be used to create malicious packets or exfiltrate data."),
    ("HX5060", "MarshalImport", "Suspicious marshal import.", "`marshal` module can be used to obfuscate data or execute arbitrary code."),
    ("HX6000", "Base64String", "Long Base64-encoded string detected; possible code obfuscation.", "Base64-encoded strings can be used to obfuscate code or data."),
    ("HX6010", "HexedLiterals", "List of hex-encoded literals detected; possible payload.", "Hex-encoded literals can be used to craft malicious payloads or shellcode."),
    ("HX6020", "HexedString", "Long hex-encoded string detected; possible payload.", "Hex-encoded strings can be used to craft malicious payloads or shellcode."),
    ("HX6030", "IntLiterals", "Large list of integer literals detected; possible code obfuscation.", "Large lists of integer literals can be used to obfuscate code, craft malicious payloads or shellcode."),
    ("HX6040", "CVEInLiteral", "Literal contains a CVE identifier.", "CVE mentioned. This code may implement an exploit for this particular CVE."),
    ("HX6050", "SuspiciousLiteral", "Suspicious literal detected; possible data enumeration.", None),
    ("HX6060", "PathTraversal", "Suspicious path traversal.", None),
    ("HX6070", "BrowserExtension", "Enumeration of sensitive browser extensions.", "Enumeration of sensitive browser extensions. Usually used to steal credentials."),
    ("HX6080", "WebHook", "Suspicious webhook detected. Possible data exfiltration.", "Webhooks are often used to exfiltrate (upload) collected data."),
    ("HX6090", "TelegramToken", "Telegram bot token detected in string literal.", "Telegram bot tokens grant API access to the bot and can be used to exfiltrate data or control the bot."),
    ("HX7000", "SuspiciousFunctionName", "Suspicious function name.", None),
    ("HX7010", "SuspiciousParameterName", "Suspicious parameter name.", None),
    ("HX7020", "SuspiciousVariable", "Suspicious variable name.", None),
    ("HX8000", "BinaryDownload", "Suspicious binary download.", None),
    ("HX8010", "BuiltinsVariable", "Suspicious builtin variable usage.", None),
    ("HX8020", "SuspiciousComment", "Suspicious comment.", None),
    ("HX8030", "SuspiciousWrite", "Suspicious write to the filesystem.", "Writing to files with to suspicious extensions (.exe, .py) can be used to store malicious payloads."),
    ("HX8040", "InstallHook", "Suspicious install hook setup.", "Custom install commands in setup.py can execute arbitrary code at package install time."),
    ("HX9000", "DataExfiltration", "Potential data exfiltration.", "Data exfiltration is the unauthorized transfer of data from a computer."),
]

# Sensitive environment variables.
ENV_VARS = """
ACCESS_TOKEN ALCHEMY_API_KEY ANTHROPIC_API_KEY API_KEY AUTH_TOKEN AWS_ACCESS_KEY AWS_ACCESS_KEY_ID AWS_SECRET_ACCESS_KEY AWS_SECRET_KEY AWS_SESSION_TOKEN
AZURE_CLIENT_ID AZURE_CLIENT_SECRET AZURE_PASSWORD AZURE_STORAGE_CONNECTION_STRING AZURE_STORAGE_KEY AZURE_USERNAME binance_api binance_secret BITCOIN_PRIVATE_KEY
BITTREX_API_KEY BITTREX_SECRET_KEY BOT_TOKEN BSC_PRIVATE_KEY CI_DEPLOY_PASSWORD CI_JOB_TOKEN CIRCLE_TOKEN CLOUDFLARE_API_TOKEN CODECOV_TOKEN CONSUMER_SECRET
DATABASE_URL DB_PASSWORD DIGITALOCEAN_ACCESS_TOKEN DOCKER_PASSWORD DOCKER_USERNAME ETHEREUM_PRIVATE_KEY FACEBOOK_APP_SECRET GCP_PROJECT GEMINI_API_KEY GH_TOKEN
GITHUB_TOKEN GITLAB_TOKEN GOOGLE_API_KEY GOOGLE_APPLICATION_CREDENTIALS GOOGLE_CLIENT_ID GOOGLE_CLIENT_SECRET HELIUS_API_KEY HEROKU_API_KEY HEROKU_API_USER
HUGGINGFACE_TOKEN INFURA_API_KEY JENKINS_TOKEN JWT_SECRET KUBERNETES_SERVICE_ACCOUNT_TOKEN MAILGUN_API_KEY MNEMONIC NETLIFY_AUTH_TOKEN NGROK_TOKEN NODE_AUTH_TOKEN
NPM_AUTH_TOKEN NPM_TOKEN OKTA_CLIENT_TOKEN OPENAI_API_KEY POSTGRES_PASSWORD PRIVATE_KEY PYPI_PASSWORD PYPI_TOKEN QUICKNODE_API_KEY SECRET_KEY SEED_PHRASE
SENTRY_AUTH_TOKEN SESSION_TOKEN SLACK_BOT_TOKEN SLACK_TOKEN SOLANA_PRIVATE_KEY SSH_KEY SSH_PRIVATE_KEY STRIPE_SECRET_KEY TELEGRAM_BOT_TOKEN TELEGRAM_TOKEN
TRON_PRIVATE_KEY TWINE_PASSWORD TWINE_USERNAME VAULT_TOKEN VERCEL_TOKEN WALLET_PRIVATE_KEY
""".split()

# Literal patterns in order of precedence, as pattern, description, confidence, rule.
_BASE_PATTERNS = [
    ("POST / HTTP/1", "Suspicious raw POST request. Potential exploitation.", 3, "HX6050"),
    ("GET / HTTP/1.", "Suspicious raw GET request. Potential exploitation.", 3, "HX6050"),
    ("uname -a", "Suspicious command. Reconnaissance checks.", 3, "HX6050"),
    ("/bin/sh", "Suspicious command. Potential exploitation.", 3, "HX6050"),
    ("CVE-", "Literal mentions CVE. Potential exploitation.", 3, "HX6040"),
    ("../../..", "Path traversal", 2, "HX6060"),
    ("discord.com/api/webhooks/", "Discord webhook detected. Possible data exfiltration.", 4, "HX6080"),
    ("//webhook.site/", "Webhook.site webhook detected. Possible data exfiltration.", 4, "HX6080"),
    ("xmrig", "XMRig miner detected. Possible cryptomining activity.", 4, "HX6050"),
    ("powershell.exe", "Suspicious PowerShell command. Potential exploitation.", 3, "HX6050"),
    (".ssh/id_rsa", "Enumeration of a private SSH key. Possible data exfiltration.", 2, "HX6050"),
    ("WScript.Shell", "Suspicious usage of Windows Shell. Potential exploitation.", 3, "HX6050"),
    (".aws/credentials", "Enumeration of AWS credentials file. Possible data exfiltration.", 3, "HX6050"),
    ("kubernetes.io/serviceaccount/", "Enumeration of Kubernetes service account. Possible data exfiltration.", 3, "HX6050"),
    (".dockerenv", "Enumeration of Docker environment file. Possible data exfiltration.", 3, "HX6050"),
    ("/dev/tcp", "Suspicious TCP connection attempt. Potential exploitation.", 3, "HX6050"),
    ("canarytokens.com", "Canarytokens URL detected. Possible data exfiltration.", 4, "HX6050"),
    ("oastify.com", "Burp Collaborator URL detected. Possible out-of-band data exfiltration.", 4, "HX9000"),
    ("burpcollaborator.net", "Burp Collaborator URL detected. Possible out-of-band data exfiltration.", 4, "HX9000"),
    ("oast.pro", "OAST (OOB) domain detected. Possible out-of-band data exfiltration.", 4, "HX9000"),
    ("oast.live", "OAST (OOB) domain detected. Possible out-of-band data exfiltration.", 4, "HX9000"),
    ("oast.site", "OAST (OOB) domain detected. Possible out-of-band data exfiltration.", 4, "HX9000"),
    ("pyobfuscate", "pyobfuscate detected in a literal. Potential code obfuscation.", 5, "HX6050"),
    ("pwned", "pwned detected in a literal. Potential harmful code.", 3, "HX6050"),
    ("api.telegram.org", "Telegram API URL detected. Possible data exfiltration.", 2, "HX6050"),
    ("serveousercontent.com", "Serveo tunnel domain detected. Possible C2 communication.", 3, "HX6050"),
    ("serveo.net", "Serveo tunnel domain detected. Possible C2 communication.", 3, "HX6050"),
    ("localhost.run", "SSH tunnel domain detected. Possible C2 communication.", 3, "HX6050"),
]
_BROWSER_PATHS = [
    ("Opera Software", 4), ("Google/Chrome", 4), ("Chromium/User Data/", 4), ("BraveSoftware/Brave-Browser", 4), ("Yandex/YandexBrowser", 4), ("Vivaldi/User Data", 4),
    ("Application Support/Vivaldi/", 4), ("Microsoft/Edge", 4), ("Mozilla/Firefox", 4), ("Cookies/Cookies", 4), ("Default/Extensions", 4), ("Default/Network/Cookies", 4),
    ("Default/Cookies", 4), ("Default/History", 4), ("Login Data/", 4), ("Web Data/", 4), ("Local State/", 4), ("Bookmarks/", 4), ("cookies.sqlite", 2), ("Network/Cookies", 4),
    ("logins.json", 4), ("key4.db", 4), (".config/google-chrome", 4), (".config/chromium", 4), ("Local Storage/leveldb", 4), ("Discord/Local Storage/leveldb", 4),
    ("Safari/LocalStorage/", 4), ("Library/Safari", 4), ("Application Support/Chromium/", 4),
]
_APPS = [
    ("1Password", 3), ("Armory", 2), ("binance", 2), ("Bitcoin", 2), ("Bitwarden", 2), ("Coinbase", 2), ("Discord", 2), ("Electrum", 2), ("exodus.wallet", 4), ("Guarda", 2),
    ("Jaxx", 2), ("KeePass", 2), ("LastPass", 2), ("Ledger", 2), ("Metamask", 2), ("Telegram", 2), ("TREZOR", 2),
]
_PATHS = [
    ("/etc/passwd", 3), ("/etc/shadow", 3), ("/etc/group", 3), ("/.ssh/id_rsa", 4), ("/.ssh/authorized_keys", 4), (".bitcoin/", 4), (".ethereum/", 4), (".solana/", 4),
    (".config/solana", 4), (".lightning/", 4), (".electrum/", 4), (".metamask/", 4), (".exodus/", 3), (".npmrc", 3), (".gitconfig", 3), (".pypirc", 3), (".git-credentials", 4),
    (".docker/config.json", 4), (".config/pip/pip.conf", 4), ("/proc/", 3), ("/.aws/", 4), (".netrc", 4), ("Start Menu/Programs", 4), ("/Extension/background.js", 4),
]
_KEYWORDS = [
    ("shellcode", 3), ("webshell", 3), ("base64.b64", 4), ("import subprocess", 4), ("import socket", 4), ("import requests", 4), ("import urllib", 4), ("import pty", 4),
    ("from subprocess import", 4), ("from socket import", 4), ("from requests import ", 4), ("from urllib import", 4), ("from pty import", 4),
]
_EXTENSIONS = [
    ("Authenticator", "bhghoamapcdpbohphigoooaddinpkbai"), ("Binance", "fhbohimaelbohpjbbldcngcnapndodjp"), ("Bitapp", "fihkakfobkmkjojpchpfgcmhfjnmnfpi"),
    ("BoltX", "aodkkagnadcbobfpggfnjeongemjbjca"), ("Coin98", "aeachknmefphepccionboohckonoeemg"), ("Coinbase", "hnfanknocfeofbddgcijnmhnfnkdnaad"),
    ("Core", "agoakfejjabomempkjlepdflaleeobhb"), ("Crocobit", "pnlfjmlcjdjgkddecgincndfgegkecke"), ("Equal", "blnieiiffboillknjnepogjhkgnoapac"),
    ("Ever", "cgeeodpfagjceefieflmdfphplkenlfk"), ("ExodusWeb3", "aholpfdialjgjfhomihkjbmgjidlcdno"), ("Fewcha", "ebfidpplhabeedpnhjnobghokpiioolj"),
    ("Finnie", "cjmkndjhnagcfbpiemnkdpomccnjblmj"), ("Guarda", "hpglfhgfnhbgpjdenjgmdgoeiappafln"), ("Guild", "nanjmdknhkinifnkgdcggcfnhdaammmj"),
    ("HarmonyOutdated", "fnnegphlobjdpkhecapkijjdkgcjhkib"), ("Iconex", "flpiciilemghbmfalicajoolhkkenfel"), ("Jaxx Liberty", "cjelfplplebdjjenllpjcblmjkfcffne"),
    ("Kaikas", "jblndlipeogpafnldhgmapagcccfchpi"), ("KardiaChain", "pdadjkfkgcafgbceimcpbkalnfnepbnk"), ("Keplr", "dmkamcknogkgcdfhhbddcghachkejeap"),
    ("Liquality", "kpfopkelmapcoipemfendmdcghnegimn"), ("MEWCX", "nlbmnnijcnlegkjjpcfjclmcfggfefdm"), ("MaiarDEFI", "dngmlblcodfobpdpecaadgfbcggfjfnm"),
    ("Martian", "efbglgofoippbgcjepnhiblaibcnclgk"), ("Math", "afbcbjpbpfadlkmhmclhkeeodmamcflc"), ("Metamask", "nkbihfbeogaeaoehlefnkodbefgpgknn"),
    ("Metamask2", "ejbalbakoplchlghecdalmeeeajnimhm"), ("Mobox", "fcckkdbjnoikooededlapcalpionmalo"), ("Nami", "lpfcbjknijpeeillifnkikgncikgfhdo"),
    ("Nifty", "jbdaocneiiinmjbjlgalhcelgbejmnid"), ("Oxygen", "fhilaheimglignddkjgofkcbgekhenbh"), ("PaliWallet", "mgffkfbidihjpoaomajlbgchddlicgpn"),
    ("Petra", "ejjladinnckdgjemekebdpeokbikhfci"), ("Phantom", "bfnaelmomeimhlpmgjnjophhpkkoljpa"), ("Pontem", "phkbamefinggmakgklpkljjmgibohnba"),
    ("Ronin", "fnjhmkhhmkbjkkabndcnnogagogbneec"), ("Safepal", "lgmpcpglpngdoalbgeoldeajfclnhafa"), ("Saturn", "nkddgncdjgjfcddamfgcmfnlhccnimig"),
    ("Slope", "pocmplpaccanhmnllbbkpgfliimjljgo"), ("Solfare", "bhhhlbepdkbapadjdnnojkbgioiodbic"), ("Sollet", "fhmfendgdocmcbmfikdcogofphimnkno"),
    ("Starcoin", "mfhbebgoclkghebffdldpobeajmbecfk"), ("Swash", "cmndjbecilbocjfkibfbifhngkdmjgog"), ("TempleTezos", "ookjlbkiijinhpmnjffcofjonbfbgaoc"),
    ("TerraStation", "aiifbnbfobpmeekipheeijimdpnlpgpp"), ("Tokenpocket", "mfgccjchihfkkindfppnaooecgfneiii"), ("Ton", "nphplpgoakhhjchkkhmiggakijnkhfnd"),
    ("Tron", "ibnejdfjmmkpcnlpebklmnkoeoihofec"), ("Trust Wallet", "egjidjbpglichdcondbcbdnbeeppgdph"), ("Wombat", "amkmjjmmflddogmhpjloimipbofnfjih"),
    ("XDEFI", "hmeobnfnfcmdkdcmlblgagmfpfboieaf"), ("XMR.PT", "eigblbgjknlfbajkfhopmcojidlgcehm"), ("XinPay", "bocpokimicclpaiekenaeelehdjllofo"),
    ("Yoroi", "ffnbelfdoeiohenkjibnmadjiehjhajb"), ("iWallet", "kncchdigobghenbbaddojjnnaogfppfj"),
]
LITERAL_PATTERNS = (
    _BASE_PATTERNS
    + [(p, f"Potential enumeration of {p} browser path.", c, "HX1010") for p, c in _BROWSER_PATHS]
    + [(p, f"Potential enumeration of {p} app", c, "HX1000") for p, c in _APPS]
    + [(p, f"Potential enumeration of {p} on file system.", c, "HX1020") for p, c in _PATHS]
    + [(p, f"Suspicious keyword {p} found.", c, "HX6050") for p, c in _KEYWORDS]
    + [(p, f"Enumeration of {name} browser extension.", 4, "HX6070") for name, p in _EXTENSIONS]
)

# Suspicious modules, as name, description, confidence, rule.
IMPORTS = [
    ("struct", None, 2, "HX5040"), ("ctypes", None, 2, "HX5020"), ("pickle", None, 2, "HX5030"), ("marshal", None, 2, "HX5060"), ("socket", None, 2, "HX5050"),
    ("scapy", "scapy can be used to craft malicious packets.", 2, "HX5010"),
    ("impacket", "impacket can be used to craft malicious payload", 2, "HX5010"),
    ("winappdbg", "winappdbg can be used to access process memory.", 2, "HX5010"),
    ("stegano", "stegano is a library that can be used to hide data in images.", 2, "HX5010"),
    ("judyb", "judyb is a library that can be used to hide data in images.", 2, "HX5010"),
    ("steganography", "steganography is a library that can be used to hide data in images.", 2, "HX5010"),
    ("pynput", "pynput can be used to monitor input devices and implement keyloggers.", 2, "HX5010"),
    ("keyboard", "keyboard enables global key event hooks and keylogging.", 2, "HX5010"),
    ("mss", "mss package allows taking screenshots of your system", 2, "HX5010"),
    ("telnetlib", "telnetlib can be used to automate Telnet sessions for unauthorized access.", 2, "HX5010"),
    ("ftplib", "ftplib can be used to exfiltrate data", 2, "HX5010"),
    ("pyperclip", "pyperclip can be used to copy and paste data from the clipboard.", 3, "HX5010"),
    ("paramiko", "paramiko can be used to automate SSH sessions for unauthorized access.", 2, "HX5010"),
    ("win32com", "win32com can be used to exploit Windows systems.", 2, "HX5010"),
    ("getpass", "getpass can be used to capture user credentials.", 2, "HX5010"),
    ("browser_cookie3", "browser-cookie3 can be used to steal browser cookies.", 4, "HX5010"),
]

# Small word lists.
IDENTIFIERS = [("shellcode", 3), ("payload", 2), ("exploit", 3), ("webshell", 3), ("_obfuscator_", 5), ("__pyarmor__", 5), ("pyobfuscate", 5), ("reverse_shell", 4), ("pwned", 4)]
COMMENTS = [
    ("BlankOBF", "BlankOBF is a code obfuscation tool that can be used to hide malicious code."),
    ("obfuscated by", "Code obfuscation tools can be used to hide malicious code."),
    ("Pyarmor", "Pyarmor is a code obfuscation tool that can be used to hide malicious code."),
]
DOWNLOAD_EXTENSIONS = [".exe", ".dll", ".so", ".dylib", ".bin", ".ps1", ".bat", ".cmd", ".scr", ".cpl", ".msi", ".jar", ".sh"]
TEMP_MARKS = ["gettempdir", "NamedTemporaryFile", "/tmp/", "\\temp\\", "$TMP", "%TEMP%", "%TMP%"]
WRITE_EXTENSIONS = [".exe", ".py", ".pyw", ".ps1", ".bat", ".cmd", ".sh"]
LITERAL_EXTENSIONS = [".exe", ".dll", ".bat", ".sh", ".ps1", ".vbs", ".so"]
DANGEROUS_COMMANDS = ["curl", "wget", "powershell", "ifconfig", "netcat", "/bin/sh", "base64", "/dev/tcp", "start /B"]
DOC_MARKS = ["example:", "for example", "e.g.", "usage:", "tutorial", "documentation", "docs"]
IGNORED_DYNAMIC_IMPORTS = ["typing", "pkg_resources", "pkgutil"]
VERSION_FILES = ["__init__.py", "version.py", "__version__.py", "about.py"]
SETUP_ELEVATED = ["HX1030", "HX3000", "HX3010", "HX3050", "HX4000", "HX4010", "HX9000"]
SENSITIVE_ATTRIBUTES = """__import__ eval exec system popen Popen run call check_output getstatusoutput getoutput posix_spawn
execl execle execlp execlpe execv execve execvp execvpe spawnl spawnle spawnlp spawnlpe spawnv spawnve spawnvp spawnvpe""".split()
STDLIB = """os sys io re json csv xml math random datetime collections pathlib glob tempfile shutil base64 hashlib hmac binascii struct pickle marshal shelve sqlite3
zipfile tarfile gzip bz2 lzma zlib configparser string textwrap subprocess threading multiprocessing asyncio socket ssl http urllib smtplib ftplib ctypes inspect ast
importlib functools itertools operator warnings logging argparse uuid getpass platform signal mmap""".split()
IMPORT_PAIRS = [
    ("base64", "socket"),
    ("base64", "requests"),
    ("base64", "urllib"),
    ("base64", "smtplib"),
    ("base64", "ftplib"),
    ("os", "socket"),
    ("os", "requests"),
    ("os", "urllib"),
    ("os", "httplib"),
    ("subprocess", "socket"),
    ("subprocess", "requests"),
    ("os", "base64"),
    ("subprocess", "base64"),
    ("ctypes", "base64"),
    ("ctypes", "socket"),
    ("ctypes", "requests"),
    ("subprocess", "smtplib"),
    ("os", "smtplib"),
    ("os", "ftplib"),
    ("winreg", "os"),
    ("winreg", "subprocess"),
    ("cryptography", "os"),
    ("crypto", "os"),
    ("cryptography", "subprocess"),
    ("crypto", "subprocess"),
    ("pathlib", "requests"),
    ("pathlib", "urllib"),
]
IMPORT_TRIPLES = [
    ("base64", "socket", "os"),
    ("base64", "requests", "subprocess"),
    ("ctypes", "socket", "base64"),
    ("os", "base64", "smtplib"),
    ("os", "socket", "subprocess"),
    ("ctypes", "os", "subprocess"),
    ("base64", "os", "subprocess"),
]

# Thresholds.
MAX_ARCHIVE_BYTES, MAX_ARCHIVE_ENTRIES = 50 * 1024 * 1024, 15_000
BASE64_LEAST, BASE64_LONG, BASE64_HIGH, HEX_LONG = 8, 100, 200, 100
HEXED_MORE_THAN, INTS_MORE_THAN = 10, 20
LITERAL_BYTES = (8, 512)
ARCHIVE_PASSWORD = b"infected"

# Taint kinds in order of precedence, and where they come from.
TAINT_ORDER = ["Decoded", "Deobfuscated", "NetworkSourced", "FileSourced", "Fingerprinting", "EnvVariables"]
CALL_TAINTS = {
    "Decoded": """base64.b64decode base64.urlsafe_b64decode binascii.a2b_base64 binascii.unhexlify bytes.fromhex zlib.decompress codecs.decode marshal.loads
        pickle.loads""".split(),
    "Deobfuscated": "__import__ builtins.__import__ __builtins__.__import__".split(),
    "FileSourced": "pathlib.Path.read_text pathlib.Path.read_bytes".split(),
    "NetworkSourced": """requests.get requests.post requests.request urllib.request.urlopen http.client.HTTPConnection.request socket.socket socket.socket.recv
        socket.socket.recvfrom""".split(),
    "Fingerprinting": """os.uname os.getlogin os.getuid os.getgid os.getcwd getpass.getuser platform.system platform.platform platform.version platform.release
        platform.node platform.processor platform.machine platform.architecture platform.uname socket.gethostname socket.getfqdn socket.gethostbyname uuid.getnode""".split(),
    "EnvVariables": ["os.getenv"],
}
ATTRIBUTE_TAINTS = {"os.environ": "EnvVariables", "sys.argv": "Fingerprinting", "sys.platform": "Fingerprinting", "sys.modules": "Deobfuscated"}
TAINT_STOPPERS = ["len", "int", "float", "bool", "isinstance", "type"]
RECEIVER_METHODS = """pop get copy union intersection values items fileno encode decode strip lstrip rstrip replace lower upper split read readlines read_bytes
read_text""".split()
MUTATORS = ["append", "extend", "insert", "reverse", "update", "add"]

# Qualified names by what they do.
_EXEC_FAMILY = "execl execle execlp execlpe execv execve execvp execvpe spawnl spawnle spawnlp spawnlpe spawnv spawnve spawnvp spawnvpe"
SHELL_COMMANDS = ["execfile"] + [f"os.{x}" for x in f"{_EXEC_FAMILY} startfile system popen popen2 popen3 popen4 posix_spawn posix_spawnp".split()] \
    + [f"subprocess.{x}" for x in "Popen call check_call check_output run getoutput getstatusoutput".split()] \
    + ["asyncio.create_subprocess_shell", "asyncio.create_subprocess_exec"] + [f"popen2.{x}" for x in "popen2 popen3 popen4 Popen3 Popen4".split()] \
    + ["commands.getoutput", "commands.getstatusoutput"]
CODE_EXEC = [f"{p}{x}" for p in ("", "builtins.", "__builtins__.", ".") for x in ("exec", "eval")]
INDIRECT_EXEC = ["threading.Thread", "multiprocessing.Process"]
EXFIL_SINKS = [f"requests.{x}" for x in "get post request put patch delete".split()] + ["http.client.HTTPConnection.request", "http.client.HTTPSConnection.request"] \
    + [f"socket.socket.{x}" for x in "send sendall sendto".split()] + [f"smtplib.{c}.{m}" for c in ("SMTP", "SMTP_SSL") for m in ("sendmail", "send_message")] \
    + [f"ftplib.{c}.{m}" for c in ("FTP", "FTP_TLS") for m in ("storbinary", "storlines")]
EXFIL_URLLIB = r"^urllib[0-9]*(\..*)?\.(urlopen|Request)$"
DOWNLOADS = ["requests.get", "requests.post", "requests.request"] + [f"{m}.{x}" for m in ("urllib", "urllib2", "urllib.request", "urllib.request.request") for x in ("urlopen", "urlretrieve")]
FINGERPRINTS = "os.uname os.getlogin getpass.getuser".split() + [f"platform.{x}" for x in "system platform version release node processor machine architecture uname".split()] \
    + ["socket.gethostname", "socket.getfqdn", "os.environ.copy"]
CLIPBOARD = ["pyperclip.paste", "win32clipboard.GetClipboardData"]
SCREENSHOTS = ["ImageGrab.grab", "PIL.ImageGrab.grab", "pyscreenshot.grab", "pyautogui.screenshot", "mss.mss.grab", "d3dshot.create.screenshot"]
ENV_CALLS = ["os.environ.get", "os.getenv"]
DLL_CALLS = r"^ctypes\.CDLL$|^(ctypes\.)?windll\.(.*\.)?[^.]+\.(OpenProcess|CreateRemoteThread|CreateProcessW|CreateProcessA|LoadLibraryA|VirtualAllocEx|WriteProcessMemory|RtlMoveMemory|ShellExecuteW|ShellExecuteA|WinExec)$"
PATH_WRITES = ["pathlib.Path.write_text", "pathlib.Path.write_bytes"]
SETUP_CALLS = ["setup", "setuptools.setup", "distutils.core.setup"]
IMPORT_CALLS = ["__import__", "builtins.__import__", "__builtins__.__import__", "importlib.import_module"]
GETATTR = ["getattr", "builtins.getattr", "__builtins__.getattr"]
REGISTRIES = ["globals", "locals", "vars", "builtins", "__builtins__", "sys.modules"]
CONSTRUCTORS = ["Path", "pathlib.Path", "socket.socket", "smtplib.SMTP", "smtplib.SMTP_SSL", "ftplib.FTP", "ftplib.FTP_TLS"]
SUSPICIOUS_BUILTINS = "__import__ compile getattr globals locals vars eval exec".split()
IGNORED_EXFIL_KEYWORDS = ["headers", "auth", "cookies"]

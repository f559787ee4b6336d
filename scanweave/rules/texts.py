"""What each rule means and what to do about it: ``id: (description, fix)``."""

TEXTS = {
    # access control
    "A01-001": ("A route handler is defined without an authorization decorator.", "Guard the handler with a login or permission decorator."),
    "A01-002": ("An object id comes straight from the request, so callers may reach other people's records.", "Check that the current user owns the object before loading it."),
    "A01-003": ("A file is opened by a name taken from the request.", "Resolve the name under a fixed base directory and reject anything outside it."),
    "A01-004": ("Every origin may call this service from a browser.", "List the allowed origins explicitly."),
    "A01-005": ("An administration path appears without a role check nearby.", "Require an administrator role on every administration route."),
    # cryptography
    "A02-001": ("MD5 is broken and must not protect anything.", "Use SHA-256 or better; use argon2 or bcrypt for passwords."),
    "A02-002": ("SHA-1 collisions are practical.", "Use SHA-256 or better."),
    "A02-003": ("A signing key is written in the source.", "Read the key from the environment or a secret store and rotate it."),
    "A02-004": ("An obsolete cipher or the ECB mode is in use.", "Use AES-GCM or ChaCha20-Poly1305."),
    "A02-005": ("A remote address is contacted without TLS.", "Use https addresses."),
    "A02-006": ("A predictable random generator is in use.", "Use a cryptographic generator for tokens, keys and ids."),
    "A02-007": ("Certificate verification is switched off.", "Verify certificates; install the private CA if there is one."),
    # injection
    "A03-001": ("SQL text is put together by string formatting.", "Pass values as query parameters."),
    "A03-002": ("A raw SQL interface may receive user input.", "Use the query builder or bind parameters."),
    "A03-003": ("A system command may be run with input from outside.", "Pass an argument list without a shell and allow known commands only."),
    "A03-004": ("Text is evaluated as code.", "Parse the data instead of evaluating it."),
    "A03-005": ("HTML is written into the page unescaped.", "Set text content, or sanitise the HTML first."),
    "A03-006": ("An LDAP filter is put together from strings.", "Escape filter values with the library's function."),
    "A03-007": ("An XML parser may resolve external entities.", "Disable DTDs and external entities."),
    "A03-008": ("A document-store operator takes request data.", "Check types and allow known operators only."),
    "A03-009": ("A template is built from request data.", "Keep templates fixed and pass the data as variables."),
    "A03-010": ("User text is merged into a model prompt.", "Keep instructions and user text in separate messages and filter the input."),
    # design
    "A04-001": ("An authentication route has no rate limit nearby.", "Limit attempts per account and address."),
    "A04-002": ("Request fields are used without validation.", "Validate the request against a schema."),
    # configuration
    "A05-001": ("Debug mode is on.", "Turn debug mode off outside development."),
    "A05-002": ("Responses go out with no protective headers set.", "Add the usual security headers, for example through middleware."),
    "A05-003": ("A default password is set.", "Remove the default and require a chosen secret."),
    "A05-004": ("A cookie is set without its protective attributes.", "Set HttpOnly, Secure and SameSite."),
    "A05-005": ("A stack trace may reach the client.", "Log the trace and answer with a generic message."),
    # components
    "A06-001": ("A dependency accepts any version.", "Pin the version and commit the lock file."),
    "A06-002": ("What gets installed can change from one build to the next.", "Pin versions with hashes or a lock file."),
    # authentication
    "A07-001": ("Token verification may be bypassed.", "Name the accepted algorithms and always verify."),
    "A07-002": ("A password may be stored as it was typed.", "Store an argon2 or bcrypt hash."),
    "A07-003": ("A token is signed with a short fixed secret.", "Use a long random secret from a secret store."),
    "A07-004": ("Logging out does not end the session.", "Clear the session and revoke its tokens."),
    # integrity
    "A08-001": ("Untrusted bytes may be unpickled, which runs code.", "Use JSON or another data-only format."),
    "A08-002": ("Untrusted objects may be deserialised.", "Filter the accepted classes or use a data-only format."),
    "A08-003": ("YAML is loaded with a loader that can build objects.", "Use safe_load."),
    # logging
    "A09-001": ("A secret may be written to the log.", "Let only harmless fields reach the log."),
    "A09-002": ("An exception is dropped without a trace.", "Log the exception or let it rise."),
    # request forgery
    "A10-001": ("The server fetches an address taken from the request.", "Allow known hosts only and block private address ranges."),
    "A10-002": ("A redirect target is taken from the request.", "Redirect to relative or listed targets only."),
    # code quality
    "CQ-001": ("An unfinished-work marker was left in a comment.", "Finish the work or open an issue."),
    "CQ-002": ("Code is commented out.", "Delete it; the history keeps it."),
    "CQ-003": ("Output is printed directly.", "Use a logger with levels."),
    "CQ-010": ("Every exception is caught alike.", "Catch the exceptions you can handle."),
    "CQ-011": ("An exception is caught and ignored.", "Handle the exception or log it."),
    "CQ-012": ("A promise has no error handler.", "Add a catch handler or await inside try."),
    "CQ-013": ("A request value is converted without handling bad input.", "Catch conversion errors and answer with a client error."),
    "CQ-020": ("Code is nested very deeply.", "Return early or extract functions."),
    "CQ-021": ("A number is used without a name.", "Give the number a named constant."),
    "CQ-030": ("A secret is compared with a plain equality test.", "Use a constant-time comparison."),
    "CQ-031": ("Global state is changed or defined as a mutable object.", "Pass state explicitly or keep it in an object."),
    "CQ-032": ("An error message may carry sensitive data.", "Keep the message generic and log the details safely."),
    "CQ-033": ("A regular expression has several unbounded repeats.", "Simplify the expression or bound its input."),
    "CQ-040": ("A whole-module import may be unused.", "Remove imports that are not used."),
    "CQ-041": ("An unsafe or deprecated function is called.", "Use the safer replacement."),
    "CQ-050": ("The repository defines code but no tests were found.", "Add tests for the main paths."),
    "CQ-051": ("A credential is written into test code.", "Generate test credentials or read them from the environment."),
    # web
    "WEB-001": ("Schema introspection is open.", "Disable introspection in production."),
    "WEB-002": ("A graph API has no depth limit nearby.", "Limit query depth and complexity."),
    "WEB-003": ("Request fields are assigned to a model in bulk.", "Copy an explicit list of fields."),
    "WEB-004": ("A route has no version in its path.", "Put a version such as v1 in the path."),
    "WEB-005": ("A query returns all rows.", "Add pagination with an upper bound."),
    "WEB-010": ("Cross-site request protection is switched off.", "Keep the protection on for state-changing requests."),
    "WEB-011": ("A GET route changes state.", "Use POST, PUT, PATCH or DELETE."),
    "WEB-020": ("Files are accepted without a type check nearby.", "Check extension, content type and size."),
    "WEB-021": ("Uploads land in a directory served to the public.", "Store uploads outside the web root."),
    "WEB-030": ("Anyone may open this socket.", "Authenticate in the handshake."),
    "WEB-031": ("A socket server does not check the origin.", "Compare the origin with a list."),
    "WEB-040": ("Pages may be framed by other sites.", "Send frame-ancestors or X-Frame-Options."),
    "WEB-041": ("The content policy allows inline script.", "Use nonces or hashes instead of unsafe-inline."),
    "WEB-042": ("TLS is enforced without strict transport security.", "Send the Strict-Transport-Security header."),
    "WEB-050": ("A secret is kept in browser storage.", "Use HttpOnly cookies."),
    "WEB-051": ("Messages are accepted from any window.", "Check the origin of the event."),
    "WEB-052": ("A privilege check runs in the browser only.", "Check privileges on the server."),
    "WEB-060": ("A regular expression may backtrack without bound.", "Avoid nested repeats and bound the input."),
    "WEB-061": ("Requests of any size are accepted.", "Set a maximum body size."),
    # mobile
    "MOB-001": ("A component is exported without a permission.", "Require a permission or do not export it."),
    "MOB-002": ("Plain-text traffic is allowed.", "Disallow it in the network security configuration."),
    "MOB-003": ("Script is enabled in a web view.", "Enable script for trusted content only."),
    "MOB-004": ("A web view can read local files.", "Disable file access."),
    "MOB-005": ("A secret is kept in plain preferences.", "Use encrypted preferences or the key store."),
    "MOB-006": ("A file is open to every app.", "Use private mode or a content provider."),
    "MOB-007": ("A key is built into the app.", "Fetch the key from your server at run time."),
    "MOB-008": ("The app can be debugged.", "Ship release builds without the flag."),
    "MOB-009": ("App data can be backed up by others.", "Disable backup or exclude sensitive files."),
    "MOB-010": ("A local database is not encrypted.", "Use an encrypted database for sensitive data."),
    "MOB-011": ("An intent does not name its receiver.", "Use explicit intents for sensitive actions."),
    "MOB-012": ("Server certificates are not pinned.", "Pin the certificate or public key."),
    "MOB-013": ("Log output remains in the app.", "Strip logging from release builds."),
    "MOB-020": ("A secret is kept in user defaults.", "Use the keychain."),
    "MOB-021": ("Plain-text loads are allowed everywhere.", "Name exceptions per domain."),
    "MOB-022": ("A keychain item is readable too widely.", "Use an accessibility class bound to the unlocked device."),
    "MOB-023": ("Sensitive platform calls run without an integrity check.", "Add device integrity checks where risk demands it."),
    "MOB-024": ("A script bridge takes messages unchecked.", "Validate message names and bodies."),
    "MOB-025": ("A key is built into the app.", "Fetch the key from your server at run time."),
    "MOB-026": ("Server certificates are not pinned.", "Pin the certificate or public key."),
    "MOB-030": ("A secret is kept in plain preferences.", "Use a secure storage plugin."),
    "MOB-031": ("A request is sent without TLS.", "Use https addresses."),
    "MOB-040": ("A secret is kept in unencrypted storage.", "Use the platform key store."),
    "MOB-041": ("A key is built into the app bundle.", "Fetch the key from your server at run time."),
    # embedded
    "EMB-001": ("A network password is written in the firmware.", "Provision it at set-up time into protected storage."),
    "EMB-002": ("All devices share the broker login in this source.", "Use per-device credentials or certificates."),
    "EMB-003": ("An administration password is written in the firmware.", "Require a password to be chosen at set-up."),
    "EMB-004": ("A service key is written in the firmware.", "Keep keys in a secure element or on the server."),
    "EMB-010": ("A device talks without TLS.", "Use the TLS client."),
    "EMB-011": ("Messages go to the broker without TLS.", "Use TLS, usually port 8883."),
    "EMB-012": ("Certificate verification is switched off.", "Install the CA certificate and verify."),
    "EMB-013": ("A radio service accepts any peer.", "Require bonding and authentication."),
    "EMB-014": ("Firmware is updated without a signature check.", "Verify a signature before applying the image."),
    "EMB-020": ("Serial output remains in the firmware.", "Compile it out of release builds."),
    "EMB-021": ("The debug port is open.", "Lock the debug port in production."),
    "EMB-022": ("Secure boot is not configured nearby.", "Enable secure boot."),
    "EMB-030": ("An unbounded string function is called.", "Use the bounded variant and check the length."),
    "EMB-031": ("An allocation is not checked.", "Test the result before using it."),
    "EMB-032": ("A stack buffer may receive outside input.", "Check the length before copying."),
    "EMB-040": ("A task starts without a stack check.", "Enable overflow checks and watch the stack."),
    "EMB-041": ("A lock may stay taken on an error path.", "Release the lock on every path."),
    "EMB-050": ("A camera or scene session starts without a consent check nearby.", "Ask for permission and explain the use."),
    "EMB-051": ("Body data is used without encryption nearby.", "Encrypt it at rest and in transit."),
    "EMB-052": ("Location is read without privacy limits nearby.", "Use coarse location and ask only while in use."),
    "EMB-053": ("A scene map may be stored.", "Ask for consent and let the user delete it."),
    "EMB-054": ("Voice is captured without protection nearby.", "Process it on the device or encrypt it."),
    # build and cloud
    "PIPE-001": ("The image runs as root.", "Switch to an unprivileged user."),
    "PIPE-002": ("No unprivileged user is set near the base image.", "Add a USER line with an unprivileged user."),
    "PIPE-003": ("A secret is set in an image variable.", "Pass secrets at run time."),
    "PIPE-004": ("A secret is passed as a build argument.", "Use build secrets."),
    "PIPE-005": ("The base image floats.", "Pin a version or digest."),
    "PIPE-006": ("A container is privileged.", "Drop the flag and add single capabilities."),
    "PIPE-007": ("A container shares the host network.", "Use a bridge network and publish ports."),
    "PIPE-008": ("The container can control its host's engine.", "Do not mount the engine's socket."),
    "PIPE-009": ("No health check is set near the base image.", "Add a HEALTHCHECK line."),
    "PIPE-010": ("A secret is kept in plain YAML.", "Use sealed or external secrets."),
    "PIPE-011": ("A container runs as root.", "Set runAsNonRoot and a user id."),
    "PIPE-012": ("A container has no resource limits.", "Set requests and limits."),
    "PIPE-013": ("A container may gain privileges.", "Set allowPrivilegeEscalation to false."),
    "PIPE-014": ("A binding grants full control of the cluster.", "Grant the needed permissions only."),
    "PIPE-015": ("A container has no probes.", "Add readiness and liveness probes."),
    "PIPE-020": ("A secret may be printed in a build log.", "Never echo secrets."),
    "PIPE-021": ("A build step floats.", "Pin it to a commit."),
    "PIPE-022": ("The build token may write everything.", "Grant the needed scopes only."),
    "PIPE-023": ("Outside changes run with secrets.", "Use the plain trigger or require approval."),
    "PIPE-024": ("Outside text is put into a shell script.", "Pass it through an environment variable."),
    "PIPE-030": ("A credential is written in infrastructure code.", "Use variables fed from a secret store."),
    "PIPE-031": ("A bucket is open to the public.", "Block public access."),
    "PIPE-032": ("A port is open to the world.", "Restrict the source ranges."),
    "PIPE-033": ("Remote state is not encrypted.", "Set encrypt to true."),
    "PIPE-034": ("A database is reachable from the internet.", "Set publicly_accessible to false."),
    "PIPE-040": ("A download is run directly.", "Download, verify a checksum, then run."),
    "PIPE-041": ("A package registry is named explicitly.", "Confirm the registry is trusted and pinned."),
    # machine learning
    "AIML-001": ("User text is joined into the instructions of a model.", "Keep roles separate and filter the input."),
    "AIML-002": ("A model's tool call may run code.", "Allow known tools and check their arguments."),
    "AIML-003": ("A model is given file or shell tools.", "Grant narrow tools and ask for confirmation."),
    "AIML-004": ("A model's answer is used unchecked.", "Validate the answer against a schema."),
    "AIML-005": ("Retrieved text enters the prompt unchecked.", "Mark and filter retrieved text."),
    "AIML-006": ("A model provider key is written in the source.", "Read the key from the environment."),
    "AIML-007": ("A tool lets a model run commands.", "Run it in a sandbox or remove it."),
    "AIML-008": ("A model call has no token limit nearby.", "Set a token limit and watch the cost."),
    "AIML-010": ("A model file of unknown origin is loaded.", "Load checked files from trusted places only."),
    "AIML-011": ("A model file may run code when loaded.", "Set weights_only or use a data-only format."),
    "AIML-012": ("Training data is read without checks nearby.", "Validate schema and ranges."),
    "AIML-013": ("Training data may hold personal data.", "Remove or pseudonymise it."),
    "AIML-014": ("An experiment server is used without authentication nearby.", "Configure credentials."),
    "AIML-015": ("A prediction endpoint does not check its input.", "Validate the input against a schema."),
    "AIML-016": ("A notebook holds a secret.", "Remove it, rotate it and clear the outputs."),
    "AIML-017": ("Models are fetched or pushed here with nothing that limits who may.", "Use private models and tokens."),
    "AIML-020": ("A vector store is used without authentication nearby.", "Configure credentials."),
    "AIML-021": ("Retrieval does not filter by what the user may see.", "Filter by tenant or user."),
    "AIML-030": ("A demo app has no login nearby.", "Add authentication."),
    "AIML-031": ("The instructions of a model are fixed in the source.", "Keep secrets out of them and filter answers."),
    # secrets
    "SEC-001": ("A cloud access key id is written in a file.", "Revoke the key and use roles."),
    "SEC-002": ("A private key is written in a file.", "Revoke the key and keep keys in a secret store."),
    "SEC-003": ("A source-host token is written in a file.", "Revoke the token."),
    "SEC-004": ("A chat token is written in a file.", "Revoke the token."),
    "SEC-005": ("A signed token is written in a file.", "Revoke the token and issue short-lived ones."),
    "SEC-006": ("An address carries a user name and password.", "Take the credentials out of the address."),
    "SEC-007": ("A secret is assigned as a quoted value.", "Read it from the environment or a secret store."),
    "SEC-008": ("A live payment key is written in a file.", "Revoke the key."),
    "SEC-009": ("A browser API key is written in a file.", "Restrict or revoke the key."),
    "SEC-010": ("An environment file is part of the repository.", "Remove it, ignore it and rotate its secrets."),
}

"""Texts from everyday sites, manuals and reports, none of them from the test tables: kind of residue (None: proper content) and text.

``DEV`` (every second one, and ``LATER``) served to set the weights and word classes of ``residue``; ``HELD_OUT``
(the others, and ``LAST``) only measures it.
"""

ERROR = r"""
Page not found
We can't find the page you're looking for.
HTTP Error 503. The service is unavailable.
404. That's an error. The requested URL was not found on this server. That's all we know.
Not Found\n\nThe requested URL was not found on this server.\n\nApache/2.4.41 (Ubuntu) Server at example.org Port 80
The server encountered an internal error or misconfiguration and was unable to complete your request.
500 - Internal server error.\nThere is a problem with the resource you are looking for, and it cannot be displayed.
Error establishing a database connection
There has been a critical error on this website. Please check your site admin email inbox for instructions.
This site can't be reached. shop.example.org took too long to respond.
ERR_CONNECTION_REFUSED
This page isn't working right now. If the problem continues, contact the site owner. HTTP ERROR 500
Error 522: Connection timed out
Error 1020\nAccess denied\nYou do not have access to example.org. The site owner may have set restrictions that prevent you from accessing the site.
Sorry, you have been blocked. You are unable to access example.net
429 Too Many Requests\nnginx
<html><head><title>504 Gateway Time-out</title></head><body><center><h1>504 Gateway Time-out</h1></center><hr><center>nginx/1.18.0</center></body></html>
<!DOCTYPE html><html><head><title>Error 500 (Server Error)!!1</title></head><body><p>That's an error.</p></body></html>
<?xml version="1.0" encoding="UTF-8"?><Error><Code>AccessDenied</Code><Message>Access Denied</Message><RequestId>0A4959</RequestId></Error>
<Error><Code>NoSuchKey</Code><Message>The specified key does not exist.</Message></Error>
{"message": "API rate limit exceeded for 203.0.113.9.", "documentation_url": "https://docs.example.org"}
{"status": 404, "error": "Not Found", "path": "/api/v1/items/7"}
{"detail": "Authentication credentials were not provided."}
{"errors": [{"message": "Cannot query field 'x' on type 'Query'.", "locations": []}]}
Traceback (most recent call last):\n  File "/srv/app/main.py", line 12, in <module>\n    import nothing\nModuleNotFoundError: No module named 'nothing'
Exception in thread "main" java.lang.NullPointerException\n\tat com.example.App.run(App.java:14)\n\tat com.example.App.main(App.java:5)
java.lang.OutOfMemoryError: Java heap space\n\tat java.util.Arrays.copyOf(Arrays.java:3332)
panic: runtime error: index out of range [5] with length 3\n\ngoroutine 1 [running]:\nmain.main()\n\t/tmp/x.go:8 +0x1d
Fatal error: Uncaught Error: Call to undefined function foo() in /var/www/html/index.php:3
Warning: mysqli_connect(): (HY000/1045): Access denied for user 'web'@'localhost' (using password: YES) in /var/www/html/db.php on line 4
TypeError: Cannot read properties of undefined (reading 'map')\n    at List (bundle.js:2210:17)
Unhandled Exception: System.NullReferenceException: Object reference not set to an instance of an object.
Segmentation fault (core dumped)
ORA-00942: table or view does not exist
You have an error in your SQL syntax; check the manual that corresponds to your MySQL server version for the right syntax to use near '' at line 1
The page you requested could not be found. It may have been moved or renamed.
Sorry, this content isn't available right now.
This video is no longer available because the uploader has closed their account.
The link you followed may be broken, or the page may have been removed.
Whoops, looks like something went wrong.
An unexpected error has occurred. Please try again later.
An error occurred while processing your request. Reference #18.2f1d
Service temporarily unavailable. We are down for maintenance and will be back shortly.
We're sorry, but the site is experiencing technical difficulties.
Session timed out. Please log in again.
You are not authorized to view this page.
You must be logged in to view this content.
Please sign in to continue.
Permission denied. Contact your administrator.
Login required
Your request could not be processed.
Unable to load comments. Retry?
Failed to load resource. Refresh the page.
Something broke on our end. We have been notified and are working on it.
Request timed out. Reload to try again.
Too many login attempts. Wait a few minutes before trying again.
The requested resource is not available.
Bad Request (Invalid Hostname)
Forbidden\nYou don't have permission to access / on this server.
Invalid security token. Please go back and reload the form.
No results could be loaded.
Ein Fehler ist aufgetreten. Bitte versuchen Sie es später erneut.
Seite nicht gefunden
Die angeforderte Seite konnte nicht gefunden werden.
Die von Ihnen gesuchte Seite existiert nicht mehr.
Der Server ist vorübergehend nicht verfügbar. Bitte laden Sie die Seite neu.
Zugriff verweigert. Sie haben keine Berechtigung für diese Seite.
Ups, da ist etwas schiefgelaufen.
Wegen Wartungsarbeiten ist unser Angebot derzeit nicht erreichbar.
Interner Serverfehler (500)
Verbindung zur Datenbank fehlgeschlagen.
Sie müssen angemeldet sein, um diesen Inhalt zu sehen.
Ihre Anfrage konnte nicht verarbeitet werden.
Zu viele Anfragen. Bitte warten Sie einen Moment.
Diese Website ist nicht erreichbar.
Không tìm thấy trang bạn yêu cầu.
Trang bạn tìm kiếm không tồn tại hoặc đã bị xóa.
Đã xảy ra lỗi. Vui lòng thử lại sau.
Máy chủ hiện không khả dụng, xin thử lại sau ít phút.
Bạn không có quyền truy cập trang này.
Lỗi máy chủ nội bộ 500
Yêu cầu đã hết thời gian chờ. Vui lòng tải lại trang.
Vui lòng đăng nhập để tiếp tục.
Nội dung này hiện không xem được.
Hệ thống đang bảo trì, mời quay lại sau.
Kết nối cơ sở dữ liệu thất bại.
"""

SCRIPT_NOTICE = r"""
JavaScript must be enabled in order to use this site.
You need to enable JavaScript to run this app.
JavaScript is not available.\nWe've detected that JavaScript is disabled in this browser. Please enable JavaScript or switch to a supported browser to continue.
This website requires JavaScript. Please turn it on in your browser settings.
Please turn JavaScript on and reload the page.
For full functionality of this site it is necessary to enable JavaScript.
Sorry, this site doesn't work properly without JavaScript enabled.
Enable JavaScript and cookies to continue
Checking if the site connection is secure. This requires JavaScript.
Just a moment...\nChecking your browser before accessing example.org.
Your browser is out of date. Update it to view this site correctly.
Your browser does not currently recognize any of the video formats available.
We noticed that your browser has scripts turned off.
To view this page ensure that JavaScript is switched on.
It looks like JavaScript is either disabled or not supported by your browser.
This feature needs JavaScript.
JavaScript required
Javascript is currently not supported or is disabled by this browser.
<noscript>Please allow scripts to see the map.</noscript>
Turn on scripting to use the editor.
Scripts must be allowed for this application to load.
Without JavaScript this form cannot be submitted.
This application works best with JavaScript enabled; please activate it.
An ad blocker or disabled scripting prevents this page from loading.
Please activate JavaScript in your browser and try again.
Your browser's JavaScript is turned off, so the player cannot start.
Um diese Website zu nutzen, müssen Sie JavaScript aktivieren.
Bitte schalten Sie JavaScript ein, um fortzufahren.
Für diese Seite wird JavaScript benötigt.
JavaScript ist in Ihrem Browser deaktiviert.
Ihr Browser unterstützt kein JavaScript.
Diese Anwendung funktioniert nur mit aktiviertem JavaScript.
Ihr Browser ist veraltet. Bitte aktualisieren Sie ihn, um die Seite anzuzeigen.
Ohne JavaScript lässt sich diese Karte nicht darstellen.
Sie haben Skripte blockiert; erlauben Sie diese für unsere Seite.
Zum Anzeigen der Inhalte ist JavaScript erforderlich.
Bạn cần bật JavaScript để xem trang này.
Trang web yêu cầu JavaScript để hoạt động.
Vui lòng kích hoạt JavaScript trong trình duyệt của bạn.
JavaScript đã bị tắt trên trình duyệt này.
Trình duyệt của bạn không hỗ trợ JavaScript.
Hãy cho phép chạy script để tiếp tục.
Ứng dụng này không chạy được nếu không có JavaScript.
Trình duyệt của bạn đã cũ, hãy cập nhật để xem nội dung.
"""

PLACEHOLDER = r"""
[Insert summary here]
[Your Name]
[YOUR COMPANY NAME]
Dear {{first_name}}, thank you for your order.
Hello {name}, welcome back!
Dear [Customer Name],
Hi %FIRSTNAME%, your parcel is on its way.
Price: {{ product.price }} EUR
Copyright {{ year }} All rights reserved.
Posted by ${author} on ${date}
Subject: %(subject)s
Order <ORDER_NUMBER> has shipped.
{{#if user}}Welcome {{user.name}}{{/if}}
{% block title %}
{% if items %} You have {{ items|length }} items. {% endif %}
<%= @user.email %> has invited you.
Your code is ##CODE##.
Welcome to [[site_name]]
Reply to @@EMAIL@@ before Friday.
The meeting takes place on [DATE] at [TIME].
Contact: <your email address>
Author: <insert name>
Signed: ____________ (name)
Date: TBD
Owner: TODO
Impact: (to be completed)
Root cause: [to be determined]
Analyst: <name>
Version $VERSION$ of the tool
Total: $TOTAL_AMOUNT$ due now
The client is {{client}}.
Ticket number __TICKET__ was opened today.
The quarterly figure was {{amount}} million.
Phone: <phone number>
City: #{city}
Sehr geehrte/r {{anrede}} {{nachname}},
Ihr Ansprechpartner ist [Name einfügen].
Datum: [Datum eintragen]
Wir treffen uns in <Ort eintragen>.
Ihre Kundennummer lautet %KUNDENNUMMER%.
Kính gửi {{ten_khach_hang}},
Ngày: [điền ngày]
Họ tên: <nhập họ tên>
Đơn hàng ${ma_don_hang} đã được gửi đi.
"""

FILLER = r"""
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium.
Coming soon.
Under construction
Content goes here
Your text here
Add your description here.
Click here to edit this text.
This is a sample paragraph. Replace it with your own text.
Placeholder text
Sample text, please ignore.
test test test test test test
asdf asdf asdf jkl jkl asdf jkl asdf jkl asdf
qwerty uiop qwerty uiop asdfgh qwerty zxcvbn uiop qwerty asdfgh
blah blah blah blah blah blah blah
foo bar foo bar foo bar foo bar foo bar
This text is a placeholder and will be replaced.
This is dummy text for layout purposes only.
Description to be added.
Text will follow.
Details to follow soon.
Enter the body of the article here.
Insert a short introduction in this section.
No content yet.
Example title
This page intentionally left blank.
Write something about yourself here.
Type the document title
Hier steht Ihr Text.
Hier könnte Ihr Text stehen.
Dies ist ein Blindtext und wird später ersetzt.
Platzhaltertext
Inhalt folgt in Kürze.
Bitte hier eine Beschreibung einfügen.
Beispielabsatz, der noch ausgetauscht werden muss.
Diese Seite befindet sich im Aufbau.
Nội dung sẽ được cập nhật sau.
Nhập nội dung tại đây.
Đây là văn bản mẫu, vui lòng thay thế.
Thêm mô tả của bạn ở đây.
Trang đang được xây dựng.
Văn bản giữ chỗ
"""

PROPER = r"""
In Jinja, you write {{ name }} to print a variable.
404 Not Found responses rose during the scan from 10.0.0.1.
Our tutorial shows how to use <%= name %> in ERB views.
Something went wrong with the router, so the team replaced it on Monday and traffic recovered.
A Mustache tag such as {{title}} is replaced by the value of the key when the template is rendered.
Shell variables are expanded with ${HOME}, which is safer than $HOME inside strings.
In Python, "%(count)d items" % values fills a format string from a mapping.
Use the <NAME> syntax in the man page to mark a required argument.
The attacker sent ${jndi} lookups in the user agent field.
String interpolation in Ruby uses #{expression} inside double quotes.
Angular binds the property with {{ item }} and updates the view on change.
The command line takes <FILE> as its argument and prints a checksum.
The documentation says that [DATE] is replaced by the current day.
A Django template can extend a base file with {% extends %} and fill its blocks.
The scanner tried {{config}} and {{self}} as template injection payloads against the login form.
Liquid filters are written after a pipe, as in {{ price | money }}.
Set the path to `${project.dir}/logs` and restart the agent.
Our server returned 500 Internal Server Error for three hours on Tuesday because the disk was full.
The proxy answered 502 Bad Gateway twice and then recovered.
After the patch, error 404 is no longer shown for deleted items.
Customers complained that the message "page not found" appeared after checkout.
The status code 403 Forbidden means that the server understood the request but refuses to authorize it.
A 404 error occurs when the client requests a resource that the server does not have.
The connection timed out three times before the backup link took over.
Access to the archive was denied to the contractor, as the audit of May shows.
The session expired while the analyst was writing the summary, so she signed in again and repeated it.
Users were locked out after too many login attempts, which is what the policy asks for.
The service was unavailable between 02:00 and 02:40 and no packets were lost.
The exception was raised in the parser and handled by the caller.
NullPointerException is the most common exception in older Java code.
A traceback shows the call stack at the moment an exception was raised.
The page was moved to the new portal in 2021 and its readers followed.
The malware disables JavaScript in the browser and then redirects the victim.
JavaScript is a programming language that runs in browsers and on servers.
Scripts on the build machine need access to the package mirror.
Most phishing kits need JavaScript, so blocking scripts stopped 80 % of them.
The team enabled JavaScript linting in the build last week.
The crawler does not run scripts, which is why it saw an empty page.
Our browser tests require a display server to be installed.
Disabling scripts in the mail client reduced the attack surface.
The site checks the browser version and logs it with each request.
The advisory recommends that administrators turn off JavaScript in the PDF reader.
Lorem ipsum is a dummy text that printers have used since the sixteenth century.
Designers fill empty layouts with dummy text to judge the typography.
The placeholder attribute of an input shows a hint until the user types.
The template was approved and the final text was sent to the printer.
The author asked us to write the summary before noon.
She inserted the sample here and closed the lid.
The bridge is under construction and opens in spring.
The test set and the test bench were compared in a second test.
The new release is coming soon, according to the vendor, and fixes four bugs.
Replace the filter every six months and clean the housing.
Please enter the building through the north door.
Write down the serial number before you remove the cover.
Blah blah is how the witness summed up the speech.
no no no, said the operator, and pulled the plug
We found that two thirds of the alerts came from one subnet.
The cafe serves soup, bread, cheese, olives, wine, water, coffee, tea and cake.
Host list: alpha, bravo, charlie, delta, echo, foxtrot, golf, hotel, india, juliet
Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda
Red maple, white oak, black walnut, sugar pine, river birch, yellow poplar
Section [A] covers routing and section [B] covers switching.
The matrix has entries a[i] and b[j] with i < j.
See [RFC 2119] for the meaning of these words.
The figures [in brackets] are estimates.
The range is {1, 2, 3} and its complement is {4}.
Prices rose by 5 % in May and by 7 %in June.
CSS rules such as body { color: red } apply to the whole page.
if (x < y && y > z) { return x; }
<p>Hello <b>world</b>, this is a paragraph.</p>
The file __init__.py marks a package.
The variable __name__ equals "__main__" in a script.
Send mail to <alice@example.org> or call the desk.
TODO lists help many people to finish their work.
The to-do item was closed by the second shift.
Der Server war am Montag zwei Stunden nicht erreichbar, weil der Strom ausfiel.
Die Meldung "Seite nicht gefunden" erschien nach dem Umzug bei vielen Kunden.
Die Prüfer fanden den Fehler in der dritten Schicht und behoben ihn.
JavaScript wird seit 1995 entwickelt und läuft in jedem Browser.
Der Angreifer schaltete JavaScript im Browser des Opfers ein.
In der Vorlage steht {{ name }} für den Namen des Empfängers.
Der Zugriff auf das Archiv wurde dem Dienstleister verweigert.
Ein Blindtext dient Gestaltern dazu, ein Layout zu beurteilen.
Die Platzhalter der Vorlage ersetzt das Programm vor dem Druck.
Die Baustelle befindet sich im Aufbau der dritten Spur.
Máy chủ không khả dụng trong hai giờ vì mất điện vào thứ Hai.
Thông báo "không tìm thấy trang" xuất hiện sau khi chuyển máy chủ.
JavaScript là ngôn ngữ lập trình chạy trong trình duyệt.
Kẻ tấn công tắt JavaScript trên máy của nạn nhân rồi chuyển hướng.
Trong mẫu, {{ ten }} được thay bằng tên người nhận.
Nhóm trực đã sửa lỗi 500 trên máy chủ vào tối qua.
Phiên họp hết giờ nên nhóm hẹn lại tuần sau.
Văn bản mẫu giúp người thiết kế đánh giá bố cục.
The gateway could not complete 14 of the 900 requests, and each was retried.
Your report from last week helped the desk to close the case.
You can turn off the alert once the host is clean.
Try again later was the advice of the vendor, so we waited until Friday.
Sign in to the console, open the case and compare the two flows.
If the page stays blank, check the proxy settings and clear the cache.
We could not find any sign of lateral movement on the file server.
Nothing was found in the second capture.
The requested change was not approved by the board.
The user was not authorized to change the rule, and the change was rolled back.
The download failed twice because the mirror was out of space.
"""


#: Written after the first weights were set.
LATER_ERROR = r"""
Hmm. We're having trouble finding that site.
This account has been suspended. Contact your hosting provider for more information.
The requested URL /wp-login.php was not found on this server.
Gone\nThe requested resource is no longer available on this server and there is no forwarding address.
This item is not available in your region.
Your IP address has been blocked due to suspicious activity.
Sorry, we can't process your payment at the moment. Please try again.
Proxy Error\nThe proxy server received an invalid response from an upstream server.
{"code": 500, "message": "Internal server error"}
Caused by: java.net.ConnectException: Connection refused\n\tat java.net.Socket.connect(Socket.java:589)
Notice: Undefined index: id in /home/site/view.php on line 22
Cannot GET /dashboard
Bad Gateway
Die Sitzung wurde wegen Inaktivität beendet. Bitte melden Sie sich neu an.
Leider ist diese Seite derzeit nicht verfügbar.
Entschuldigung, hier ist etwas schiefgelaufen.
Xin lỗi, trang này hiện không truy cập được.
Phiên đăng nhập của bạn đã hết hạn.
Có lỗi xảy ra khi tải dữ liệu, vui lòng thử lại.
"""
LATER_NOTICE = r"""
Please switch JavaScript on to continue.
Our site needs scripts. Please allow them in your settings.
JavaScript appears to be disabled in your browser.
You are using an unsupported browser. Please upgrade.
This map cannot be displayed without JavaScript.
Bitte erlauben Sie Skripte, um das Formular zu nutzen.
In Ihrem Browser ist JavaScript abgeschaltet.
Trình duyệt không hỗ trợ script, bạn hãy đổi trình duyệt khác.
Cần có JavaScript để hiển thị bản đồ này.
"""
LATER_PLACEHOLDER = r"""
Hi [First Name], we missed you!
Invoice for {{ customer.company }}
Prepared by: <author>
Delivery: TBA
The sensor {sensor_name} raised the alarm.
Room %ROOM% is free.
Regards, [Your Signature]
Amount: ${total_amount} USD
Sehr geehrter Herr [Nachname eintragen], vielen Dank.
Kính gửi ông [điền tên], cảm ơn ông.
"""
LATER_FILLER = r"""
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Put your summary here.
Placeholder heading
Article text to follow.
hello hello hello hello hello hello
Dieser Text ist nur ein Platzhalter.
Text folgt.
Nội dung đang được cập nhật.
This section is still to be written.
"""
LATER_PROPER = r"""
The error rate fell after the cache was enabled.
A user reported that the page could not be loaded on her phone, and the desk reproduced it.
Gateway timeouts doubled in March.
Requests that failed were retried with a delay of two seconds.
The parser throws a ValueError if the list is empty.
HTTP 429 tells a client to slow down.
The expired certificate was renewed by the night shift.
Browsers cache the file for a day.
The plug-in runs scripts in a sandbox, and the tests confirm it.
Turning off scripts breaks many sites.
In Handlebars, {{#each}} repeats a block for every element of the list.
Replace %USER% with your login name, as the manual says.
The expression ${a + b} is evaluated by the engine.
The word "placeholder" occurs four times in the log.
The description is short and the title is long.
Here the path splits and leads to the river.
Text mining helps to sort the tickets.
Die Fehlerrate sank nach dem Umbau deutlich.
Skripte auf dem Server sichern die Daten jede Nacht.
Im Text folgt auf die Frage eine Antwort.
Tỉ lệ lỗi giảm sau khi bật bộ nhớ đệm.
Tập lệnh sao lưu chạy mỗi đêm trên máy chủ.
Nội dung báo cáo gồm ba phần và một phụ lục.
Packets with an invalid checksum were dropped by the firewall.
We could not reach the owner of 10.0.0.7, so the case stays open.
The login page of the portal was copied by the attacker.
"""


#: Written after ``LATER`` had served to widen the word classes.
LAST_ERROR = r"""
We are currently experiencing an outage. Please try again in a few minutes.
The document you are trying to open does not exist.
Your connection was interrupted.
Network error
The upstream server is not responding.
This profile is private or does not exist.
Access to this resource is forbidden.
Could not connect to the database server.
Der Link ist abgelaufen oder ungültig.
Diese Datei konnte nicht geöffnet werden.
Das System ist überlastet. Bitte versuchen Sie es in wenigen Minuten noch einmal.
Không thể kết nối tới máy chủ.
Liên kết này đã hết hạn.
RuntimeError: CUDA out of memory.
File "job.py", line 40, in main\nValueError: bad shape
"""
LAST_NOTICE = r"""
You have JavaScript disabled. Please enable it to see the comments.
Interactive maps require JavaScript.
Your browser is not supported by this application.
Bitte aktualisieren Sie Ihren Browser, er wird nicht mehr unterstützt.
Für die Anmeldung muss JavaScript eingeschaltet sein.
Trang này dùng JavaScript, hãy bật JavaScript rồi tải lại.
"""
LAST_PLACEHOLDER = r"""
Thank you, %CUSTOMER_NAME%.
Deadline: TBD
The invoice [INVOICE_NO] is overdue.
{{greeting}}, your balance is {{balance}}.
Name: <full name>
Ihr Termin am {{ termin.datum }} ist bestätigt.
Mã số: [nhập mã số]
"""
LAST_FILLER = r"""
Neque porro quisquam est qui dolorem ipsum quia dolor sit amet consectetur adipisci velit.
lkj lkj fds fds lkj jkl fds lkj jkl fds jkl
Write your abstract here.
Dummy content
Beschreibung folgt in Kürze.
Mô tả sẽ được bổ sung sau.
Heading goes here
"""
LAST_PROPER = r"""
The server room was locked and nobody had the key.
Data from the second probe were not available before June.
An outage in March taught the team to keep two links.
The document describes how a session is opened and closed.
The form asks for a name and an address.
Most pages of the report deal with storage.
The script computes the mean and writes it to a file.
The browser market changed little last year.
Each host sends one packet per second.
The image shows the entrance of the station.
Der Dienst läuft seit Mai ohne Unterbrechung.
Die Datei wurde am Freitag von zwei Personen geöffnet.
Das Skript beendet sich nach zehn Minuten selbst.
Máy chủ mới nhanh gấp đôi máy chủ cũ.
Trang bìa của báo cáo có tên ba tác giả.
The placeholder {x} in the format string is replaced by the number.
An index of {i} means the row, and {j} means the column of the matrix.
She wrote the summary here in the library.
Titles follow the style guide of the journal.
"""


def _read(kind: str | None, block: str) -> list[tuple[str | None, str]]:
    return [(kind, line.replace("\\n", "\n").replace("\\t", "\t")) for line in block.strip().split("\n")]


ALL = [*_read("error", ERROR), *_read("script_notice", SCRIPT_NOTICE), *_read("placeholder", PLACEHOLDER), *_read("filler", FILLER), *_read(None, PROPER)]
LATER = [*_read("error", LATER_ERROR), *_read("script_notice", LATER_NOTICE), *_read("placeholder", LATER_PLACEHOLDER), *_read("filler", LATER_FILLER), *_read(None, LATER_PROPER)]
LAST = [*_read("error", LAST_ERROR), *_read("script_notice", LAST_NOTICE), *_read("placeholder", LAST_PLACEHOLDER), *_read("filler", LAST_FILLER), *_read(None, LAST_PROPER)]
DEV, HELD_OUT = ALL[0::2] + LATER, ALL[1::2] + LAST

"""Pages written and labelled by hand, in styles that the made training pages do not have: (html, blocks of the main text)."""

PAGES = [
    ("""<!doctype html><html><body class="home blog"><div id=page><header id=masthead><a href=/>The Allotment Diary</a><p>Notes from plot 14</p></header>
<div id=primary><article id=post-88 class="post type-post"><h2 class=entry-title>First frost</h2><div class=entry-content><p>The dahlias went black overnight, which is my signal to lift them.</p>
<p>I let the tubers dry for a week in the shed before packing them in sand.</p></div><footer class=entry-meta>Posted in <a href=/c>Flowers</a></footer></article>
<section id=comments><h3>2 thoughts on this</h3><ol><li><p>Lovely post, thanks.</p></li></ol></section></div><div id=secondary class=widget-area><h3>Archives</h3><ul><li><a href=/10>October</a><li><a href=/9>September</a></ul></div></div></body></html>""",
     ["First frost", "The dahlias went black overnight, which is my signal to lift them.", "I let the tubers dry for a week in the shed before packing them in sand."]),
    ("""<html><body><nav class="top-nav"><a href="/">Home</a> <a href="/news">News</a> <a href="/sport">Sport</a></nav><main role="main"><h1>Bridge closed for repairs</h1><p class="byline">By our town reporter</p>
<p>The old river bridge will be shut to traffic from Monday while engineers replace worn bearings under the middle span.</p><figure><img src=b.jpg><figcaption>The bridge in spring.</figcaption></figure>
<p>Buses will follow a signed diversion, and walkers can still cross on the upstream side.</p></main><aside class="related"><h2>Most read</h2><ul><li><a href="/1">Market to move</a></li><li><a href="/2">School wins prize</a></li></ul></aside>
<footer><p>Copyright The Town Paper. All rights reserved.</p></footer></body></html>""",
     ["Bridge closed for repairs", "By our town reporter", "The old river bridge will be shut to traffic from Monday while engineers replace worn bearings under the middle span.", "The bridge in spring.", "Buses will follow a signed diversion, and walkers can still cross on the upstream side."]),
    ("""<body><div class="cookie-banner"><p>We use cookies to improve your visit. By going on you agree to this.</p><button>Accept</button></div><div class="content"><h1>Lentil soup</h1><h2>Ingredients</h2><ul><li>200 g red lentils</li><li>1 onion, chopped</li><li>1 l stock</li></ul>
<h2>Method</h2><ol><li>Fry the onion until soft.</li><li>Add the lentils and the stock, and simmer for twenty minutes.</li></ol></div><div class="newsletter-signup"><p>Get our recipes by mail every Friday.</p><form><input name=m><button>Join</button></form></div></body>""",
     ["Lentil soup", "Ingredients", "200 g red lentils", "1 onion, chopped", "1 l stock", "Method", "Fry the onion until soft.", "Add the lentils and the stock, and simmer for twenty minutes."]),
    ("""<HTML><BODY BGCOLOR=white><H1>About my telescope</H1><P>I built this eight inch reflector in the winter of 1996 from a kit and some plywood.<P>The mirror took four months to grind.<P>On clear nights it shows the bands of Jupiter well.<HR></BODY></HTML>""",
     ["About my telescope", "I built this eight inch reflector in the winter of 1996 from a kit and some plywood.", "The mirror took four months to grind.", "On clear nights it shows the bands of Jupiter well."]),
    ("""<div class="navbar"><ul><li><a href="#">Docs</a></li><li><a href="#">API</a></li></ul></div><div class="sidebar"><ul><li><a href="#a">Install</a></li><li><a href="#b">Configure</a></li><li><a href="#c">Deploy</a></li></ul></div>
<main><article><h1>Configure the server</h1><p>All settings live in one file, which the server reads when it starts.</p><pre>port = 8080
host = local</pre><p>Restart the server after each change.</p></article></main>""",
     ["Configure the server", "All settings live in one file, which the server reads when it starts.", "port = 8080 host = local", "Restart the server after each change."]),
    ("""<html><body><article><h1>Warum Brot Zeit braucht</h1><p>Ein guter Sauerteig reift über Nacht, denn die Hefen arbeiten langsam &amp; gründlich.</p><p>Wer es eilig hat, backt besser ein anderes Brot.</p></article><div class="share-buttons"><a href=#>Teilen</a> <a href=#>Drucken</a></div><div id="footer">Impressum | Datenschutz</div></body></html>""",
     ["Warum Brot Zeit braucht", "Ein guter Sauerteig reift über Nacht, denn die Hefen arbeiten langsam & gründlich.", "Wer es eilig hat, backt besser ein anderes Brot."]),
    ("""<article><header><h1>Letter from the island</h1></header><p>The ferry came twice this week, and with it the mail, two goats and a doctor.</p><blockquote><p>Nobody hurries here, said the harbour master.</p></blockquote><p>We have lamp oil until March.</p></article>""",
     ["Letter from the island", "The ferry came twice this week, and with it the mail, two goats and a doctor.", "Nobody hurries here, said the harbour master.", "We have lamp oil until March."]),
    ("""<body><div id="wrap"><div id="top"><a href="/"><img src="logo.png" alt="x"></a></div><div id="menu"><a href="/a">Start</a><a href="/b">Produkte</a><a href="/c">Kontakt</a></div><div id="text"><h1>Unsere Werkstatt</h1><p>Seit drei Generationen reparieren wir Uhren aller Art in der Altstadt.</p></div><div id="ad-right"><p>Jetzt günstig versichern!</p></div></div></body>""",
     ["Unsere Werkstatt", "Seit drei Generationen reparieren wir Uhren aller Art in der Altstadt."]),
    ("""<html><body><div class="breadcrumbs"><a href=/>Home</a> &gt; <a href=/h>Help</a></div><div class="article"><h1>Resetting a password</h1><p>Open the settings, choose security, and press the reset link.</p><p>If no mail comes within ten minutes, look in the junk folder.</p><table><tr><th>Error</th><th>Meaning</th></tr><tr><td>E12</td><td>Link too old</td></tr></table></div><form class="feedback"><p>Was this page helpful?</p><button>Yes</button><button>No</button></form></body></html>""",
     ["Resetting a password", "Open the settings, choose security, and press the reset link.", "If no mail comes within ten minutes, look in the junk folder.", "Error", "Meaning", "E12", "Link too old"]),
    ("""<main><h1>Tide tables for beginners</h1><p>A tide table lists the <a href="/hw">high water</a> and <a href="/lw">low water</a> times of a port for every day.</p><h2>Springs and neaps</h2><p>When sun and moon pull in line, the range is largest.</p></main>""",
     ["Tide tables for beginners", "A tide table lists the high water and low water times of a port for every day.", "Springs and neaps", "When sun and moon pull in line, the range is largest."]),
    ("""<body><div class="header"><h2><a href="/">Chess club</a></h2></div><div class="post-body"><p>Round four ended with three draws and one very long loss.</p><p>Anna's game lasted a hundred and nine moves.</p></div><div class="comments"><div class="comment"><p>Well played, everybody!</p></div><div class="comment"><p>What a finish.</p></div></div><div class="footer">Powered by chalk</div></body>""",
     ["Round four ended with three draws and one very long loss.", "Anna's game lasted a hundred and nine moves."]),
    ("""<html><head><title>x</title></head><body><section class="hero"><h1>How sails work</h1></section><section class="text"><p>A sail is a wing that stands upright; air runs faster round its outer side.</p><p>Trim it until the telltales stream together.</p></section><section class="sponsored"><p>Buy rope at Knots &amp; Co.</p></section></body></html>""",
     ["How sails work", "A sail is a wing that stands upright; air runs faster round its outer side.", "Trim it until the telltales stream together."]),
    ("""<div class=popup hidden><p>Sign up now!</p></div><article><h1>On mending</h1><p title=it's>A torn sleeve is a small thing until the cold comes.</p><p>Don't wait: it's an evening's work.</p></article>""",
     ["On mending", "A torn sleeve is a small thing until the cold comes.", "Don't wait: it's an evening's work."]),
    ("""<html><body><nav><ul><li><a href=/>Inicio</a><li><a href=/m>Mapa</a></ul></nav><article><h1>El faro viejo</h1><p>El faro dejó de alumbrar en 1974, pero los vecinos todavía pintan la puerta cada verano.</p><p>Desde arriba se ve toda la bahía.</p></article><aside><p>Hoteles cerca del faro</p></aside></body></html>""",
     ["El faro viejo", "El faro dejó de alumbrar en 1974, pero los vecinos todavía pintan la puerta cada verano.", "Desde arriba se ve toda la bahía."]),
    ("""<body><h1>Minutes of the meeting</h1><p>Present were nine members; two sent word that they were ill.</p><p>The roof fund stands at four hundred and twelve.</p><p>The next meeting is on the first Tuesday in May.</p></body>""",
     ["Minutes of the meeting", "Present were nine members; two sent word that they were ill.", "The roof fund stands at four hundred and twelve.", "The next meeting is on the first Tuesday in May."]),
    ("""<article><h1>Glossary of the loom</h1><dl><dt>Warp</dt><dd>The threads that run the length of the cloth and are held tight.</dd><dt>Weft</dt><dd>The thread that is carried across them.</dd></dl></article><footer><a href=/imprint>Imprint</a></footer>""",
     ["Glossary of the loom", "Warp", "The threads that run the length of the cloth and are held tight.", "Weft", "The thread that is carried across them."]),
    ("""<body><div class="alert"><p>Our office is closed on Friday.</p></div><div class="main-content"><h1>Paying your water bill</h1><p>You can pay at the counter, by post or through your bank.</p><p>Bills that are over thirty days old bear interest.</p></div><div class="sidebar"><h4>Quick links</h4><p><a href="/x">Forms</a></p></div></body>""",
     ["Paying your water bill", "You can pay at the counter, by post or through your bank.", "Bills that are over thirty days old bear interest."]),
    ("""<main><article><h1>Night train</h1><p>The conductor woke us at the border; it was snowing hard.<br>Nobody asked for a ticket.</p><p>By morning the plain was white as paper.</p></article><div class="ad"><p>Sleep better with Dormo pillows.</p></div><section class="comment-list"><article class="comment"><p>I took that train in 1988!</p></article></section></main>""",
     ["Night train", "The conductor woke us at the border; it was snowing hard. Nobody asked for a ticket.", "By morning the plain was white as paper."]),
    ("""<html><body><div><div><div><p>Deep inside many boxes without a name there is still a paragraph that somebody wrote with care.</p><p>And it is followed by another one, nearly as long as the first.</p></div></div></div></body></html>""",
     ["Deep inside many boxes without a name there is still a paragraph that somebody wrote with care.", "And it is followed by another one, nearly as long as the first."]),
    ("""<body><header class="site-header"><p>The Weekly Botanist</p><nav><a href=/>Home</a></nav></header><div class="entry-content"><h1>Moss in winter</h1><p>While the trees are bare the moss has all the light, and it grows.</p></div><div class="related-posts"><h3>You may also like</h3><ul><li><a href=/l>Lichens on slate</a></li></ul></div><footer class="site-footer"><p>Contact | Privacy</p></footer></body>""",
     ["Moss in winter", "While the trees are bare the moss has all the light, and it grows."]),
]

"""A small dump with the odd cases, written by hand."""

HEAD = """<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/" version="0.10" xml:lang="en">
  <siteinfo>
    <sitename>Test</sitename>
    <namespaces>
      <namespace key="-1" case="first-letter">Special</namespace>
      <namespace key="0" case="first-letter" />
      <namespace key="1" case="first-letter">Talk</namespace>
      <namespace key="3" case="first-letter">User talk</namespace>
    </namespaces>
  </siteinfo>
"""

PAGES = [
    # three revisions: the second is empty, the third repeats the first text; the last two share a timestamp
    """<page>
    <title>Main page</title>
    <ns>0</ns>
    <id>10</id>
    <restrictions>edit=sysop</restrictions>
<DiscussionThreading>
 <ThreadSubject>x</ThreadSubject>
</DiscussionThreading>
    <revision>
      <id>100</id>
      <timestamp>2005-08-31T01:02:03Z</timestamp>
      <contributor><username>Ann</username><id>7</id></contributor>
      <minor />
      <comment>first &amp; best</comment>
      <model>wikitext</model>
      <format>text/x-wiki</format>
      <text xml:space="preserve"> a &lt;b&gt; <![CDATA[c & d]]> <!-- gone -->é𝄞 [[Category:One]][[Category:One]] </text>
      <sha1>s100</sha1>
    </revision>
    <revision>
      <id>101</id>
      <parentid>100</parentid>
      <timestamp>2006-01-01T00:00:00Z</timestamp>
      <contributor><ip>10.0.0.1</ip></contributor>
      <text xml:space="preserve" />
      <sha1>s101</sha1>
    </revision>
    <revision>
      <id>102</id>
      <parentid>101</parentid>
      <timestamp>2006-01-01T00:00:00Z</timestamp>
      <contributor><username>Ann</username><id>7</id></contributor>
      <text xml:space="preserve"> a &lt;b&gt; c &amp; d é𝄞 [[Category:One]][[Category:One]] </text>
      <sha1>s102</sha1>
    </revision>
  </page>
""",
    # a redirect in a named namespace
    """<page>
    <title>User talk:Bob Smith</title>
    <ns>3</ns>
    <id>11</id>
    <redirect title="Main page" />
    <revision>
      <id>110</id>
      <timestamp>2007-01-01T00:00:00Z</timestamp>
      <contributor><username>Bob</username><id>8</id></contributor>
      <text>#Redirect [[Main page]]</text>
    </revision>
  </page>
""",
    # duplicate of the first title, written with an underscore
    """<page>
    <title>Main_page</title>
    <ns>0</ns>
    <id>12</id>
    <revision>
      <id>120</id>
      <timestamp>2008-01-01T00:00:00Z</timestamp>
      <contributor><username>Cy</username><id>9</id></contributor>
      <text>copy</text>
    </revision>
  </page>
""",
    # a prefix that is no namespace, and one in the wrong case
    """<page>
    <title>Other:Thing</title>
    <ns>0</ns>
    <id>13</id>
    <revision>
      <id>130</id>
      <timestamp>2008-01-01T00:00:00Z</timestamp>
      <contributor><username>Cy</username><id>9</id></contributor>
      <text>#REDIRECT without link</text>
    </revision>
  </page>
""",
    """<page>
    <title>talk:Lower</title>
    <ns>0</ns>
    <id>14</id>
    <revision>
      <id>140</id>
      <timestamp>2009-01-01T00:00:00Z</timestamp>
      <contributor><username>Cy</username><id>9</id></contributor>
      <text>null</text>
    </revision>
  </page>
""",
    # no revision at all
    """<page>
    <title>Talk:Empty</title>
    <ns>1</ns>
    <id>15</id>
  </page>
""",
    # an id that is no number
    """<page>
    <title>Broken</title>
    <ns>0</ns>
    <id>x16</id>
    <revision>
      <id>160</id>
      <timestamp>2009-01-01T00:00:00Z</timestamp>
      <text>broken</text>
    </revision>
  </page>
""",
    """<page>
    <title>Talk:After</title>
    <ns>1</ns>
    <id>17</id>
    <revision>
      <id>170</id>
      <timestamp>2010-01-01T00:00:00Z</timestamp>
      <contributor><username>Dee</username><id>5</id></contributor>
      <text>later text</text>
    </revision>
    <revision>
      <id>171</id>
      <parentid>170</parentid>
      <timestamp>2009-01-01T00:00:00Z</timestamp>
      <contributor><username>Dee</username><id>5</id></contributor>
      <text>earlier text, although it stands later</text>
    </revision>
  </page>
""",
]
CUT_OFF = """<page>
    <title>Cut</title>
    <id>18</id>
    <revision>
      <id>180</id>
      <text>never clo"""

FIRST_TEXT = " a <b> c & d é𝄞 [[Category:One]][[Category:One]] "


def write(path, cut_off=False) -> str:
    text = HEAD + "".join("  " + p for p in PAGES)
    path.write_text(text + ("  " + CUT_OFF if cut_off else "</mediawiki>\n"), encoding="utf-8")
    return str(path)

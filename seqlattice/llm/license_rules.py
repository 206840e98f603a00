"""Hand-written signatures of licenses.

A text is read as its words in lower case, one space between them, so ``Apache License, Version 2.0`` is
``apache license version 2 0``.  A head line names a label and its keywords: rules below it are tried on texts that hold a word
of every group (groups are separated by ``+``; a number also stands for its form with v).  A rule is a kind and a pattern over
whole words.  ``{under}``, ``{license}`` and ``{v}`` stand for the forms of a grant, of the word itself and of "version"; a tag is an
identifier behind ``SPDX-License-Identifier``, and only the identifier itself counts as the place.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Priority and confidence by kind: an identifier, a sentence of the license itself, a grant, an address, a title, a bare name.
KINDS = {"tag": (6, 1.0), "text": (5, 0.95), "grant": (4, 0.95), "url": (3, 0.9), "title": (2, 0.8), "name": (1, 0.5)}
FORMS = {
    "{under}": r"under (?:either |both |a |an )?(?:the )?(?:terms (?:and conditions )?(?:of|in) )?(?:the |a |an )?(?:following )?",
    "{license}": r"licen[cs]es?",
    "{v}": r"(?:version |v ?)?",
}
#: Before an identifier; other identifiers of the expression may stand between.
TAG = r"spdx license identifier (?:[a-z0-9]+ ){0,6}?"
LICENSE_WORDS = "license licence licenses licences licensed licensing spdx"

RULES_TEXT = r"""
mit : mit + LICENSE
  tag mit(?! 0)
  grant {under}mit(?: x11| expat)? {license}
  grant mit licensed
  url opensource org {license} mit(?: license)?(?: php| html)?
  url spdx org {license} mit(?: html)?
  url mit license org
  title the mit {license}(?: mit)?
  title mit(?: x11| expat| style)? {license}
  name {license} mit
mit : permission + charge + software
  text permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
  text the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 : mit + LICENSE + 0 attribution
  tag mit 0
  title mit no attribution(?: {license})?
  name mit 0 {license}
apache-2 : apache + LICENSE
  tag apache 2 0
  grant {under}apache(?: software)?(?: foundation)? {license} {v}2(?: 0)?
  grant {under}apache 2(?: 0)?(?: {license})?
  text you may not use this file except in compliance with the license you may obtain a copy of the license at (?:https? )?(?:www )?apache org {license} license 2 0
  url apache org {license} license 2 0(?: txt| html)?
  url opensource org {license} apache 2 0(?: php)?
  title apache(?: software)? {license} {v}2(?: 0)?
  title apache 2(?: 0)? {license}
  name {license} apache 2(?: 0)?
apache-1.1 : apache + LICENSE + 1
  tag apache 1 1
  grant {under}apache(?: software)? {license} {v}1 1
  title apache(?: software)? {license} {v}1 1
apache : apache + LICENSE
  grant {under}apache(?: software)?(?: foundation)? {license}
  name apache(?: software)? {license}
gpl-1 : gpl gnu + 1
  tag gpl 1 0(?: only| or later)?
  title gnu general public {license} {v}1(?: 0)?
gpl-2 : gpl gpl2 gplv2 gnu + 2 gpl2 gplv2
  tag gpl 2 0(?: only| or later)?
  grant {under}gnu general public {license} {v}2(?: 0)?
  grant {under}(?:gnu )?(?:gpl {v}2|gpl2|gplv2)(?: 0)?(?: only| or later)?
  text under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
  text gnu general public license version 2 as published by the free software foundation
  url gnu org {license} old licenses gpl 2 0(?: html| txt| en html)?
  url opensource org {license} gpl 2 0
  title gnu general public {license} (?:as published by the free software foundation )?(?:either )?{v}2(?: 0)?(?: june 1991)?
  title gnu gpl {v}2(?: 0)?
  name (?:gpl {v}2|gpl2|gplv2)(?: 0)?
gpl-3 : gpl gpl3 gplv3 gnu + 3 gpl3 gplv3
  tag gpl 3 0(?: only| or later)?
  grant {under}gnu general public {license} {v}3(?: 0)?
  grant {under}(?:gnu )?(?:gpl {v}3|gpl3|gplv3)(?: 0)?(?: only| or later)?
  text under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
  url gnu org {license} gpl 3 0(?: html| txt| en html)?
  url opensource org {license} gpl 3 0
  title gnu general public {license} (?:as published by the free software foundation )?(?:either )?{v}3(?: 0)?(?: 29 june 2007)?
  title gnu gpl {v}3(?: 0)?
  name (?:gpl {v}3|gpl3|gplv3)(?: 0)?
gpl : gpl gnu
  grant {under}gnu general public {license}
  grant {under}(?:gnu )?gpl
  text you should have received a copy of the gnu general public license along with this program
  url gnu org {license} gpl(?: html| txt| en html)?
  url gnu org copyleft gpl(?: html)?
  title gnu general public {license}
  name gnu gpl
  name gpl {license}
lgpl-2 : lgpl lgplv2 gnu + 2 lgplv2
  tag lgpl 2 0(?: only| or later)?
  grant {under}gnu library general public {license} {v}2(?: 0)?
  title gnu library general public {license} {v}2(?: 0)?
  name (?:lgpl {v}2|lgplv2)(?: 0)(?! 1)
lgpl-2.1 : lgpl gnu + lesser lgpl + 1
  tag lgpl 2 1(?: only| or later)?
  grant {under}gnu lesser general public {license} {v}2 1
  text gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
  url gnu org {license} old licenses lgpl 2 1(?: html| txt)?
  url opensource org {license} lgpl 2 1
  title gnu lesser general public {license} {v}2 1(?: february 1999)?
  name lgpl {v}2 1
lgpl-3 : lgpl lgplv3 gnu + lesser lgpl lgplv3 + 3 lgplv3
  tag lgpl 3 0(?: only| or later)?
  grant {under}gnu lesser general public {license} {v}3(?: 0)?
  text gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
  url gnu org {license} lgpl 3 0(?: html| txt)?
  title gnu lesser general public {license} {v}3(?: 0)?
  name (?:lgpl {v}3|lgplv3)(?: 0)?
lgpl : lgpl lesser library + gnu lgpl
  grant {under}gnu (?:lesser|library)(?: or lesser)? general public {license}
  grant {under}(?:gnu )?lgpl
  url gnu org {license} lgpl(?: html| txt)?
  title gnu (?:lesser|library)(?: or lesser)? general public {license}
  name lgpl {license}
agpl-3 : agpl agplv3 affero + 3 agplv3
  tag agpl 3 0(?: only| or later)?
  grant {under}gnu affero general public {license} {v}3(?: 0)?
  text gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
  url gnu org {license} agpl 3 0(?: html| txt)?
  title gnu affero general public {license} {v}3(?: 0)?(?: 19 november 2007)?
  name (?:agpl {v}3|agplv3)(?: 0)?
agpl : agpl affero
  grant {under}(?:gnu )?affero general public {license}
  grant {under}(?:gnu )?agpl
  title (?:gnu )?affero general public {license}
gfdl : gfdl gnu + gfdl documentation
  tag gfdl 1 [123](?: only| or later)?
  text permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
  grant {under}gnu free documentation {license}(?: {v}1(?: [123])?)?
  url gnu org (?:licenses|copyleft) fdl(?: html)?
  title gnu free documentation {license}(?: {v}1(?: [123])?)?
  name gnu fdl
bsd-2-clause : bsd + 2 two simplified freebsd
  tag bsd 2 clause
  grant {under}(?:simplified bsd|freebsd|(?:2|two) clause bsd|bsd (?:2|two) clause) {license}
  url opensource org {license} bsd 2 clause
  title (?:simplified bsd|freebsd|(?:2|two) clause bsd|bsd (?:2|two) clause)(?: simplified)? {license}
  name bsd 2 clause
bsd-3-clause : bsd + 3 three new modified revised
  tag bsd 3 clause
  grant {under}(?:(?:new|modified|revised) bsd|(?:3|three) clause bsd|bsd (?:3|three) clause) {license}
  url opensource org {license} bsd 3 clause
  title (?:(?:new|modified|revised) bsd|(?:3|three) clause bsd|bsd (?:3|three) clause)(?: new| revised)? {license}
  name bsd 3 clause
bsd-3-clause : endorse + contributors
  text neither the name of (?:[^ ]+ ){1,12}?may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause : bsd + 4 original
  tag bsd 4 clause
  title (?:original bsd|(?:4|four) clause bsd|bsd (?:4|four) clause) {license}
bsd-4-clause : advertising + acknowledgement acknowledgment
  text all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-0-clause : bsd 0bsd + 0 0bsd zero
  tag 0bsd
  title (?:zero clause bsd|bsd zero clause|bsd 0 clause) {license}
bsd : bsd + LICENSE
  grant {under}bsd(?: style| type)? {license}
  url opensource org {license} bsd license(?: php)?
  title bsd(?: style| type)? {license}
bsd : redistribution + binary
  text redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
isc : isc + LICENSE
  tag isc
  grant {under}isc {license}
  url opensource org {license} isc
  title isc {license}
isc : permission + fee + hereby
  text permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
mpl-2 : mozilla mpl + 2
  tag mpl 2 0(?: no copyleft exception)?
  grant {under}mozilla public {license} {v}2(?: 0)?
  text this source code form is subject to the terms of the mozilla public license v 2 0
  url mozilla org (?:en us )?mpl 2 0
  title mozilla public {license} {v}2(?: 0)?
  name mpl {v}2(?: 0)?
mpl-1.1 : mozilla mpl + 1
  tag mpl 1 1
  grant {under}mozilla public {license} {v}1 1
  url mozilla org mpl mpl 1 1(?: html)?
  title mozilla public {license} {v}1 1
  name mpl {v}1 1
mpl : mozilla
  grant {under}mozilla public {license}
  title mozilla public {license}
epl-1 : eclipse epl + 1
  tag epl 1 0
  grant {under}eclipse public {license} {v}1(?: 0)?
  url eclipse org legal epl v10(?: html)?
  title eclipse public {license} {v}1(?: 0)?
epl-2 : eclipse epl + 2
  tag epl 2 0
  grant {under}eclipse public {license} {v}2(?: 0)?
  url eclipse org legal epl (?:2 0|v20)(?: html)?
  title eclipse public {license} {v}2(?: 0)?
edl-1 : eclipse + distribution
  title eclipse distribution {license} {v}1(?: 0)?
cddl-1 : cddl common + cddl development
  tag cddl 1 [01]
  grant {under}common development and distribution {license}(?: cddl)?(?: {v}1(?: [01])?)?
  title common development and distribution {license}(?: cddl)?(?: {v}1(?: [01])?)?
  name cddl {v}1(?: [01])?
cpl-1 : common + public + ibm cpl LICENSE
  tag cpl 1 0
  title common public {license} {v}1(?: 0)?
ipl-1 : ibm
  title ibm public {license}(?: {v}1(?: 0)?)?
cc0-1 : cc0 creative + cc0 zero 0 universal
  tag cc0 1 0
  text to the extent possible under law (?:[^ ]+ ){1,12}?has waived all copyright and related or neighboring rights
  url creativecommons org publicdomain zero 1 0(?: legalcode)?
  title creative commons (?:cc0|zero|public domain dedication)(?: 1 0)?(?: universal)?
  title cc0(?: {v}1(?: 0)?)?(?: universal)?
cc-by : cc creative creativecommons + by attribution
  tag cc by [1234] [05]
  grant {under}(?:creative commons|cc) (?:by|attribution)(?: {v}[1234](?: [05])?)?(?: (?:international|unported|generic))?(?: {license})?
  url creativecommons org {license} by [1234] [05](?: legalcode| deed)?
  title (?:creative commons|cc) attribution(?: {license})?(?: {v}[1234](?: [05])?)?(?: (?:international|unported|generic))?(?: {license})?
  title cc by {v}[1234](?: [05])?
  name cc by {license}
cc-by-sa : cc creative creativecommons + sa share sharealike
  tag cc by sa [1234] [05]
  grant {under}(?:creative commons|cc) (?:by sa|attribution share ?alike)(?: {v}[1234](?: [05])?)?(?: (?:international|unported|generic))?(?: {license})?
  url creativecommons org {license} by sa [1234] [05](?: legalcode| deed)?
  title (?:creative commons|cc) attribution share ?alike(?: {v}[1234](?: [05])?)?(?: (?:international|unported|generic))?(?: {license})?
  title cc by sa(?: {v}[1234](?: [05])?)?
cc-by-nc : cc creative creativecommons + nc non noncommercial
  tag cc by nc [1234] [05]
  grant {under}(?:creative commons|cc) (?:by nc|attribution non ?commercial)(?: {v}[1234](?: [05])?)?(?: (?:international|unported|generic))?(?: {license})?
  url creativecommons org {license} by nc [1234] [05](?: legalcode| deed)?
  title (?:creative commons|cc) attribution non ?commercial(?: {v}[1234](?: [05])?)?(?: (?:international|unported|generic))?(?: {license})?
  title cc by nc(?: {v}[1234](?: [05])?)?
cc-by-nd : cc creative creativecommons + nd derivatives noderivs noderivatives
  tag cc by nd [1234] [05]
  grant {under}(?:creative commons|cc) (?:by nd|attribution no ?deriv(?:ative)?s(?: works)?)(?: {v}[1234](?: [05])?)?(?: (?:international|unported|generic))?(?: {license})?
  url creativecommons org {license} by nd [1234] [05](?: legalcode| deed)?
  title (?:creative commons|cc) attribution no ?deriv(?:ative)?s(?: works)?(?: {v}[1234](?: [05])?)?
  title cc by nd(?: {v}[1234](?: [05])?)?
cc-by-nc-sa : cc creative creativecommons + nc non noncommercial + sa share sharealike
  tag cc by nc sa [1234] [05]
  grant {under}(?:creative commons|cc) (?:by nc sa|attribution non ?commercial share ?alike)(?: {v}[1234](?: [05])?)?(?: (?:international|unported|generic))?(?: {license})?
  url creativecommons org {license} by nc sa [1234] [05](?: legalcode| deed)?
  title (?:creative commons|cc) attribution non ?commercial share ?alike(?: {v}[1234](?: [05])?)?(?: (?:international|unported|generic))?(?: {license})?
  title cc by nc sa(?: {v}[1234](?: [05])?)?
cc-by-nc-nd : cc creative creativecommons + nc non noncommercial + nd derivatives noderivs noderivatives
  tag cc by nc nd [1234] [05]
  grant {under}(?:creative commons|cc) (?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s(?: works)?)(?: {v}[1234](?: [05])?)?(?: (?:international|unported|generic))?(?: {license})?
  url creativecommons org {license} by nc nd [1234] [05](?: legalcode| deed)?
  title (?:creative commons|cc) attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: {v}[1234](?: [05])?)?
  title cc by nc nd(?: {v}[1234](?: [05])?)?
creative-commons : creative creativecommons
  grant {under}creative commons {license}
  name creative commons {license}
  url creativecommons org
unlicense : unlicense unencumbered
  tag unlicense
  text this is free and unencumbered software released into the public domain
  url unlicense org
  grant {under}unlicense
  title the unlicense
public-domain : public + domain
  text (?:dedicated|released|placed|donated|committed) (?:in|in?to) the public domain
  name (?:is|are|been|lies|falls) (?:put )?in the public domain
  name public domain dedication
wtfpl : wtfpl wtf fuck
  tag wtfpl
  title do what the f[a-z]* you want to public {license}
  grant {under}wtfpl
  name wtfpl {license}
beerware : beer beerware
  tag beerware
  title (?:the )?beer ?ware {license}
  text you think this stuff is worth it you can buy me a beer in return
zlib : zlib
  tag zlib
  grant {under}zlib(?: libpng)? {license}
  url opensource org {license} zlib(?: license)?(?: php)?
  title (?:the )?zlib(?: libpng)? {license}
zlib : misrepresented + origin
  text the origin of this software must not be misrepresented you must not claim that you wrote the original software
bsl-1 : boost bsl + LICENSE + 1 boost
  tag bsl 1 0
  grant {under}boost software {license}(?: {v}1(?: 0)?)?
  url boost org license 1 0(?: txt)?
  title boost software {license}(?: {v}1(?: 0)?)?
artistic-1 : artistic perl + 1
  tag artistic 1 0(?: perl| cl8)?
  title artistic {license} {v}1(?: 0)?
artistic-2 : artistic + 2
  tag artistic 2 0
  grant {under}artistic {license} {v}2(?: 0)?
  url opensource org {license} artistic license 2 0
  title artistic {license} {v}2(?: 0)?
artistic : artistic perl
  grant {under}(?:perl )?artistic {license}
  title (?:perl |clarified )?artistic {license}
  text under the same terms as perl itself
psf-2 : python psf + LICENSE + psf foundation
  tag (?:psf|python) 2 0
  grant {under}(?:psf|python software foundation) {license}(?: {v}2)?
  title (?:psf|python software foundation) {license}(?: agreement)?(?: (?:for python )?{v}[23](?: [0-9]+)*)?
php-3.01 : php + LICENSE + 3
  tag php 3 0 ?1
  grant {under}php {license} {v}3 01
  title php {license} {v}3 01
ruby : ruby + LICENSE
  tag ruby
  grant {under}(?:ruby s|ruby) {license}
openssl : openssl + LICENSE
  tag openssl
  grant {under}openssl {license}
  title openssl {license}
openssl : openssl + toolkit
  text this product includes software developed by the openssl project for use in the openssl toolkit
ssleay : ssleay eric + cryptographic ssleay
  text this product includes cryptographic software written by eric young
postgresql : postgresql + LICENSE
  tag postgresql
  grant {under}postgresql {license}
  title postgresql {license}
x11 : x11 + LICENSE
  tag x11
  grant {under}x11 {license}
  title x11 {license}
ncsa : ncsa illinois + LICENSE
  tag ncsa
  grant {under}(?:university of illinois )?(?:ncsa )open source {license}
  title (?:university of )?illinois (?:ncsa )?open source {license}
ms-pl : microsoft ms + pl public + LICENSE
  tag ms pl
  grant {under}microsoft public {license}(?: ms pl)?
  title microsoft public {license}(?: ms pl)?
ms-rl : microsoft ms + rl reciprocal + LICENSE
  tag ms rl
  title microsoft reciprocal {license}(?: ms rl)?
eupl-1.1 : eupl european + eupl union + 1
  tag eupl 1 1
  grant {under}(?:eupl|european union public {license})(?: eupl)? {v}1 1
  title (?:eupl|european union public {license})(?: eupl)? {v}1 1
eupl-1.2 : eupl european + eupl union + 2
  tag eupl 1 2
  grant {under}(?:eupl|european union public {license})(?: eupl)? {v}1 2
  title (?:eupl|european union public {license})(?: eupl)? {v}1 2
ofl-1.1 : ofl sil + LICENSE
  tag ofl 1 1(?: rfn| no rfn)?
  grant {under}sil open font {license}(?: {v}1(?: 1)?)?
  url scripts sil org ofl
  title sil open font {license}(?: ofl)?(?: {v}1(?: 1)?)?
odbl-1 : odbl opendatacommons database + odbl open opendatacommons
  tag odbl 1 0
  grant {under}open (?:data commons open )?database {license}(?: odbl)?(?: {v}1(?: 0)?)?
  url opendatacommons org {license} odbl(?: 1 0| summary)?
  title open (?:data commons open )?database {license}(?: odbl)?(?: {v}1(?: 0)?)?
odc-by-1 : odc opendatacommons commons + attribution by odc + data odc opendatacommons
  tag odc by 1 0
  grant {under}open data commons attribution {license}(?: {v}1(?: 0)?)?
  url opendatacommons org {license} by(?: 1 0)?
  title open data commons attribution {license}(?: {v}1(?: 0)?)?
pddl-1 : pddl opendatacommons commons + pddl dedication opendatacommons
  tag pddl 1 0
  url opendatacommons org {license} pddl(?: 1 0)?
  title open data commons public domain dedication and {license}
cdla : cdla community + cdla data + LICENSE
  tag cdla (?:permissive|sharing) [12] 0
  title community data {license} agreement(?: (?:permissive|sharing))?(?: {v}[12](?: 0)?)?
  name cdla (?:permissive|sharing)(?: {v}[12] 0)?
osl-3 : osl open + osl software + LICENSE + 3
  tag osl 3 0
  grant {under}open software {license} {v}3(?: 0)?
  title open software {license} {v}3(?: 0)?
afl-3 : afl academic + LICENSE + 3
  tag afl 3 0
  grant {under}academic free {license} {v}3(?: 0)?
  title academic free {license} {v}3(?: 0)?
ecl-2 : ecl educational + LICENSE
  tag ecl 2 0
  grant {under}educational community {license}(?: {v}2(?: 0)?)?
  title educational community {license}(?: {v}2(?: 0)?)?
upl-1 : upl universal + LICENSE + upl permissive
  tag upl 1 0
  title universal permissive {license}(?: upl)?(?: {v}1(?: 0)?)?
cpal-1 : cpal attribution + cpal common + LICENSE
  tag cpal 1 0
  title common public attribution {license}(?: {v}1(?: 0)?)?
qpl-1 : qpl trolltech + LICENSE
  tag qpl 1 0
  title q public {license}(?: {v}1(?: 0)?)?
sleepycat : sleepycat + LICENSE
  tag sleepycat
  title sleepycat {license}
vim : vim + LICENSE
  tag vim
  title vim {license}
w3c : w3c + LICENSE
  tag w3c
  title w3c software (?:notice and|and document notice and|and document) {license}
zpl : zope zpl + LICENSE
  tag zpl 2 [01]
  title zope public {license}(?: zpl)?(?: {v}2(?: [01])?)?
unicode : unicode + LICENSE
  tag unicode (?:dfs|3|tou)(?: [0-9]+)*
  title unicode {license}(?: agreement)?(?: {v}3)?
icu : icu + LICENSE
  tag icu
  title icu {license}
json : evil
  tag json
  text the software shall be used for good not evil
hpnd : historical hpnd + LICENSE
  tag hpnd
  title historical permission notice and disclaimer
curl : curl + LICENSE
  tag curl
  title curl {license}
blueoak-1 : blueoak blue + LICENSE
  tag blueoak 1 0 0
  title blue oak model {license}(?: 1 0 0)?
  url blueoakcouncil org license 1 0 0
mulan-2 : mulan mulanpsl + LICENSE
  tag mulanpsl 2 0
  title mulan permissive software {license}(?: {v}[12](?: 0)?)?
busl-1.1 : busl business + source busl + LICENSE
  tag busl 1 1
  grant {under}business source {license}(?: {v}1 1)?
  title business source {license}(?: {v}1 1)?
sspl-1 : sspl server + side sspl + LICENSE
  tag sspl 1 0
  grant {under}server side public {license}(?: {v}1)?
  title server side public {license}(?: sspl)?(?: {v}1)?
elastic-2 : elastic + LICENSE
  tag elastic 2 0
  grant {under}elastic {license}(?: {v}2(?: 0)?)?
  title elastic {license}(?: {v}2(?: 0)?)?
commons-clause : commons + clause
  title commons clause(?: {license})? condition(?: {v}1 0)?
  name commons clause {license}
polyform : polyform + LICENSE
  tag polyform (?:noncommercial|small business|shield|strict|free trial|internal use|perimeter) 1 0 0
  title polyform (?:noncommercial|small business|shield|strict|free trial|internal use|perimeter) {license}(?: 1 0 0)?
openrail : openrail rail + LICENSE
  grant {under}(?:creativeml |bigscience |bigcode )?open ?rail(?: [ms])?(?: {license})?
  title (?:creativeml |bigscience |bigcode )open ?rail(?: [ms])?(?: {license})?
  title responsible ai {license}
ogl : ogl open + government
  grant {under}open government {license}(?: {v}[123](?: 0)?)?
  title open government {license}(?: {v}[123](?: 0)?)?
proprietary : rights + reserved
  text all rights (?:are )?reserved
proprietary : proprietary confidential + confidential proprietary unauthorized unauthorised
  text proprietary and confidential
  text unauthori[sz]ed (?:copying|reproduction|distribution) of this (?:file|document|work|software|material)(?: via any medium)? is strictly prohibited
non-commercial : commercial noncommercial
  grant for (?:personal and )?non ?commercial (?:use|purposes|research) only
  grant not for commercial (?:use|purposes)
no-derivatives : derivative + works
  text may not (?:be )?(?:modif(?:y|ied)|alter(?:ed)?|creat(?:e|ed)) (?:or )?(?:[^ ]+ ){0,4}?derivative works
copyleft : copyleft
  name (?:strong|weak|network)? ?copyleft {license}
"""


class Rule(NamedTuple):
    label: str
    kind: str
    priority: int
    score: float
    pattern: re.Pattern


class Family(NamedTuple):
    gates: tuple[frozenset[bytes], ...]
    rules: tuple[int, ...]


def read_rules(text: str = RULES_TEXT) -> tuple[list[Rule], list[Family]]:
    """The rules in order, and for each head line its groups of keywords and the numbers of its rules."""
    rules: list[Rule] = []
    families: list[Family] = []
    for line in filter(str.strip, text.splitlines()):
        if not line.startswith(" "):
            label, _, gates = line.partition(" : ")
            groups = tuple(frozenset(w.encode() for x in g.replace("LICENSE", LICENSE_WORDS).split() for w in ((x, f"v{x}") if x.isdigit() else (x,))) for g in gates.split(" + "))
            families.append(Family(groups, ()))
            continue
        kind, _, pattern = line.strip().partition(" ")
        for form, shown in FORMS.items():
            pattern = pattern.replace(form, shown)
        if kind == "tag":
            pattern = f"{TAG}({pattern})"
        priority, score = KINDS[kind]
        families[-1] = Family(families[-1].gates, (*families[-1].rules, len(rules)))
        rules.append(Rule(label, kind, priority, score, re.compile(b"(?<= )(?:" + pattern.encode() + b")(?= )")))
    return rules, families

r"""Sentences of licence texts and notices: data for lodestone.llm.license_rules.

Fixed values: a line in brackets names the label, each line after it is a regex written
by hand, of which a blank stands for any white space.  They are matched whatever the case.
Groups don't nest, so that `stretches` can tell what every match must hold.
"""

from __future__ import annotations

import re

_TEXT = r"""
[mit]
permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
the above copyright notice and this permission notice shall be included in all copies or substantial portions
to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicen[cs]e
in no event shall the authors or copyright holders be liable for any claim, damages or other liability
without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement
[mit-0]
without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicen[cs]e, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so\. the software is provided
[x11]
the software is provided .as is., without warranty of any kind.{0,300}x consortium
except as contained in this notice, the names? of .{1,80} shall not be used in advertising or otherwise to promote the sale, use or other dealings in this software
[isc]
permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
and the author disclaims all warranties with regard to this software
in no event shall (?:the author|isc) be liable for any special, direct, indirect, or consequential damages or any damages whatsoever
or other tortious action, arising out of or in connection with the use or performance of this software
[curl]
provided that the above copyright notice and this permission notice appear in all copies\.
[hpnd]
permission to use, copy, modify,? and distribute this software and its documentation for any purpose and without fee is hereby granted
no representations about the suitability of this software for any purpose
it is provided .as is. without express or implied warranty
[apache-1.1]
this product includes software developed by the apache software foundation
products derived from this software may not be called .?apache
the names .{1,40}apache software foundation.? must not be used to endorse or promote products
[apache-2.0]
you may not use this file except in compliance with the licen[cs]e
unless required by applicable law or agreed to in writing, software distributed under the licen[cs]e is distributed on an .as is. basis
each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge
shall mean the terms and conditions for use, reproduction, and distribution as defined by sections 1 through 9 of this document
shall mean the copyright owner or entity authorized by the copyright owner that is granting the licen[cs]e
shall mean the union of the acting entity and all other entities that control
you must give any other recipients of the work or derivative works a copy of this licen[cs]e
you must cause any modified files to carry prominent notices stating that you changed the files
this licen[cs]e does not grant permission to use the trade names, trademarks, service marks, or product names of the licensor
if you institute patent litigation against any entity
unless you explicitly state otherwise, any contribution intentionally submitted for inclusion in the work
see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e
licensed to the apache software foundation
you may obtain a copy of the licen[cs]e at
[apache-2.0-llvm-exception]
llvm exceptions to the apache 2\.0 licen[cs]e
as an exception, if, as a result of your compiling your source code, portions of this software are embedded
[bsd-2-clause]
redistribution and use in source and binary forms, with or without modification, are permitted
redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer
redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
this software is provided by the (?:copyright holders?|author|authors|regents) and contributors .as is. and any express or implied warranties
in no event shall the (?:copyright holder|copyright owner|author|regents|foundation) or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages
procurement of substitute goods or services; loss of use, data, or profits; or business interruption
the views and conclusions contained in the software and documentation are those of the authors
[bsd-3-clause]
neither the name of .{1,120} nor the names of (?:its|their) contributors may be used to endorse or promote products
the names? of the (?:author|authors|contributors) may not be used to endorse or promote products derived from this software
no express or implied licen[cs]es to any party.s patent rights are granted by this licen[cs]e
subject to the limitations in the disclaimer below
[bsd-4-clause]
all advertising materials mentioning features or use of this software
this product includes software developed by the university of california, berkeley and its contributors
[bsd-source-code]
redistributions of source code must retain the original copyright notice
[gpl-1.0]
gnu general public licen[cs]e version 1, february 1989
[gpl-2.0]
gnu general public licen[cs]e version 2, june 1991
you may copy and distribute verbatim copies of the program.s source code as you receive it
you must cause any work that you distribute or publish, that in whole or in part contains or is derived from the program
accompany it with a written offer, valid for at least three years
this general public licen[cs]e does not permit incorporating your program into proprietary programs
as published by the free software foundation[;,] version 2 of the licen[cs]e
[gpl-3.0]
gnu general public licen[cs]e version 3, 29 june 2007
refers to version 3 of the gnu general public licen[cs]e
a work means to do anything with it that, without permission, would make you directly or secondarily liable for infringement
you may convey verbatim copies of the program.s source code as you receive it
for a user product means any methods, procedures, authorization keys
no covered work shall be deemed part of an effective technological measure
royalty-free patent licen[cs]e under the contributor.s essential patent claims
you may not propagate or modify a covered work except as expressly provided under this licen[cs]e
as published by the free software foundation[;,] version 3 of the licen[cs]e
[gpl]
you should have received a copy of the gnu general public licen[cs]e
under the terms of the gnu general public licen[cs]e
this program is distributed in the hope that it will be useful, but without any warranty
designed to take away your freedom to share and change
when we speak of free software, we are referring to freedom, not price
write to the free software foundation, inc
everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document, but changing it is not allowed
[gpl-classpath-exception]
as a special exception, the copyright holders of this library give you permission to link this library with independent modules
linking this library statically or dynamically with other modules is making a combined work based on this library
[gpl-gcc-exception]
gcc runtime library exception
[gpl-bison-exception]
as a special exception, you may create a larger work that contains part or all of the bison parser skeleton
[gpl-autoconf-exception]
as a special exception to the gnu general public licen[cs]e, if you distribute this file as part of a program that contains a configuration script generated by autoconf
[gpl-font-exception]
as a special exception, if you create a document which uses this font
[gpl-openssl-exception]
permission to link the code of .{1,80} with the openssl
[fsf-all-permissive]
copying and distribution of this file, with or without modification, are permitted in any medium without royalty
[lgpl-2.1]
either version 2\.1 of the licen[cs]e, or \(?at your option\)? any later version
gnu lesser general public licen[cs]e version 2\.1, february 1999
this is the first released version of the lesser gpl
this licen[cs]e, the lesser general public licen[cs]e, applies to some specially designated software
[lgpl-2.0]
gnu library general public licen[cs]e version 2, june 1991
this is the first released version of the library gpl
you should have received a copy of the gnu library general public licen[cs]e
terms of the gnu library general public licen[cs]e
[lgpl-3.0]
this version of the gnu lesser general public licen[cs]e incorporates the terms and conditions of version 3
is any work that makes use of an interface provided by the library
[lgpl]
terms of the gnu lesser general public licen[cs]e
you should have received a copy of the gnu lesser general public licen[cs]e
falls outside the scope of this licen[cs]e.{0,60}a work that uses the library
this library is distributed in the hope that it will be useful, but without any warranty
[agpl-3.0]
terms of the gnu affero general public licen[cs]e
you should have received a copy of the gnu affero general public licen[cs]e
gnu affero general public licen[cs]e version 3, 19 november 2007
your modified version must prominently offer all users interacting with it remotely through a computer network
[gfdl]
with no invariant sections, (?:with )?no front-cover texts
permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation licen[cs]e
the purpose of this licen[cs]e is to make a manual, textbook, or other functional and useful document .?free
is a named appendix or a front-matter section of the document
[mpl-1.1]
the contents of this file are subject to the mozilla public licen[cs]e version 1\.1
the initial developer of the original code is
subject to third party intellectual property claims, including without limitation
[mpl-2.0]
this source code form is subject to the terms of the mozilla public licen[cs]e
if a copy of the mpl was not distributed with this file
means source code form to which the initial contributor has attached the notice
incompatible with secondary licen[cs]es.?, as defined by the mozilla public licen[cs]e
means a work that combines covered software with other material
[epl-1.0]
the accompanying program is provided under the terms of this eclipse public licen[cs]e
made available under the terms of the eclipse public licen[cs]e v1\.0
[epl-2.0]
made available under the terms of the eclipse public licen[cs]e (?:v\. |v|version )?2\.0
this source code may also be made available under the following secondary licen[cs]es
[edl-1.0]
made available under the terms of the eclipse distribution licen[cs]e
[cddl-1.0]
the contents of this file are subject to the terms of the common development and distribution licen[cs]e
when distributing covered code, include this cddl header(?: notice)? in each file
means \(a\) the original software, or \(b\) modifications
[cpl-1.0]
the accompanying program is provided under the terms of this common public licen[cs]e
a contributor may choose to distribute the program in object code form under its own licen[cs]e agreement
[ipl-1.0]
the accompanying program is provided under the terms of this ibm public licen[cs]e
[apsl-2.0]
this file contains original code and/or modifications of original code as defined in and that are subject to the apple public source licen[cs]e
please obtain a copy of the licen[cs]e at .{0,60} and read it before using this file
[eupl]
licensed under the eupl
applies to the work .{0,40}which is provided under the terms of this licen[cs]e\. any use of the work, other than as authorised under this licen[cs]e is prohibited
the licensor hereby grants you a worldwide, royalty-free, non-exclusive, sublicensable licen[cs]e
[artistic-1.0]
the intent of this document is to state the conditions under which a package may be copied
you may otherwise modify your copy of this package in any way, provided that you insert a prominent notice in each changed file
aggregation of this package with a commercial distribution is always permitted
[artistic-2.0]
this licen[cs]e establishes the terms under which a given free software package may be copied, modified, distributed, and/or redistributed
you are permitted to use the standard version and create and use modified versions for any purpose without restriction
[perl]
is free software[;,] you can redistribute it and/or modify it under the same terms as perl
[boost-1.0]
free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e
unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor
distributed under the boost software licen[cs]e
in no event shall the copyright holders or anyone distributing the software be liable
[zlib]
in no event will the authors be held liable for any damages arising from the use of this software
the origin of this software must not be misrepresented
altered source versions must be plainly marked as such
this notice may not be removed or altered from any source distribution
permission is granted to anyone to use this software for any purpose, including commercial applications
[libpng]
the png reference library is supplied .as is
the contributing authors and group 42, inc\. disclaim all warranties
[ijg]
this software is based in part on the work of the independent jpeg group
[freetype]
portions of this software are copyright .{1,60} the freetype project
[imagemagick]
the legally binding and authoritative terms and conditions for use, reproduction, and distribution of imagemagick
[tcl]
the authors hereby grant permission to use, copy, modify, distribute, and licen[cs]e this software and its documentation for any purpose
government use: if you are acquiring this software on behalf of the u\.s\. government
[sleepycat]
redistributions in any form must be accompanied by information on how to obtain complete source code
[unlicense]
this is free and unencumbered software released into the public domain
anyone is free to copy, modify, publish, use, compile, sell, or distribute this software
the author or authors of this software dedicate any and all copyright interest in the software to the public domain
we intend this dedication to be an overt act of relinquishment in perpetuity
[wtfpl]
everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document, and changing it is allowed as long as the name is changed
you just do what the f\w+ you want to
[postgresql]
for any purpose, without fee, and without a written agreement is hereby granted
in no event shall the university of california be liable to any party
the university of california specifically disclaims any warranties
[python-2.0]
this licen[cs]e agreement is between the python software foundation
psf hereby grants licensee a nonexclusive, royalty-free, world-wide licen[cs]e
psf is making python available to licensee on an .as is. basis
beopen\.com licen[cs]e agreement for python 2\.0
stichting mathematisch centrum disclaims all warranties
[ruby]
you may make and give away verbatim copies of the source form of the software without restriction, provided that you (?:retain|duplicate) all of the original copyright notices
rename any non-standard executables so the names do not conflict with standard executables
the scripts and library files supplied as input to or produced as output from the software do not automatically fall under the copyright
[php-3.01]
this source file is subject to version 3\.0?1? of the php licen[cs]e
products derived from this software may not be called .?php
this product includes php software, freely available from
[zend-2.0]
this source file is subject to version 2\.00 of the zend licen[cs]e
[openssl]
this product includes software developed by the openssl project for use in the openssl toolkit
must not be used to endorse or promote products derived from this software without prior written permission\. for written permission, please contact openssl-core
this product includes cryptographic software written by eric young
[ncsa]
to deal with the software without restriction
this list of conditions and the following disclaimers
[afl-3.0]
licensed under the academic free licen[cs]e version
this academic free licen[cs]e .{0,40}applies to any original work of authorship
[osl-3.0]
licensed under the open software licen[cs]e version
this open software licen[cs]e .{0,40}applies to any original work of authorship
means the use, distribution, or communication of the original work or derivative works in any way
[nposl-3.0]
licensed under the non-profit open software licen[cs]e
[ofl-1.1]
this font software is licensed under the sil open font licen[cs]e
permission is hereby granted, free of charge, to any person obtaining a copy of the font software
neither the font software nor any of its individual components, in original or modified versions, may be sold by itself
refers to any names specified as such after the copyright statement
are to stimulate worldwide development of collaborative font projects
[ms-pl]
this licen[cs]e governs use of the accompanying software\. if you use the software, you accept this licen[cs]e
royalty-free copyright licen[cs]e to reproduce its contribution, prepare derivative works of its contribution
if you distribute any portion of the software in source code form, you may do so only under this licen[cs]e
[ms-rl]
for any file you distribute that contains code from the software \(in source code or binary format\)
[bsl-1.1]
the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the licensed work
effective on the change date, or the fourth anniversary of the first publicly available distribution
any use of the licensed work in violation of this licen[cs]e will automatically terminate your rights
[sspl-1.0]
if you make the functionality of the program or a modified version available to third parties as a service
means the corresponding source for the program or the modified version, and the corresponding source for all programs
[elastic-2.0]
you may not provide the software to third parties as a hosted or managed service
you may not move, change, disable, or circumvent the licen[cs]e key functionality in the software
[polyform]
the licensor grants you a copyright licen[cs]e for the software to do everything you might do with the software
any noncommercial purpose is a permitted purpose
[commons-clause]
the software is provided to you by the licensor under the licen[cs]e, as defined below, subject to the following condition
the grant of rights under the licen[cs]e will not include, and the licen[cs]e does not grant to you, the right to sell the software
[blueoak-1.0.0]
this licen[cs]e gives everyone as much permission to work with this software as possible
everyone who gets a copy of any part of this software from you, with or without changes, also gets the text of this licen[cs]e
no contributor can revoke this licen[cs]e
[upl-1.0]
any person obtaining a copy of this software, associated documentation and/or data \(collectively the .?software
if the software is provided with a separate larger works? file
[cecill]
this software is governed by the cecill
users are provided only with a limited warranty and the software.s author, the holder of the economic rights
ce logiciel est r.gi par la licence cecill
[mulan-2.0]
you can use this software according to the terms and conditions of the mulan
without warranties of any kind, either express or implied, including but not limited to non-infringement, merchantability or fit for a particular purpose
[json]
the software shall be used for good, not evil
[beerware]
as long as you retain this notice you can do whatever you want with this stuff
if we meet some day, and you think this stuff is worth it, you can buy me a beer in return
[cc0-1.0]
affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders
to the extent possible under law, .{1,120} has waived all copyright and related or neighboring rights
the person who associated a work with this deed has dedicated the work to the public domain
[cc-by]
this work is licensed under a creative commons attribution (?:[1-4]\.[05]|international|unported)
you must give appropriate credit, provide a link to the licen[cs]e, and indicate if changes were made
you accept and agree to be bound by the terms and conditions of this creative commons attribution [1-4]
[cc-by-sa]
you must distribute your contributions under the same licen[cs]e as the original
this work is licensed under a creative commons attribution-sharealike
terms and conditions of this creative commons attribution-sharealike
[cc-by-nd]
if you remix, transform, or build upon the material, you may not distribute the modified material
this work is licensed under a creative commons attribution-noderiv
[cc-by-nc]
you may not use the material for commercial purposes
means not primarily intended for or directed towards commercial advantage or monetary compensation
this work is licensed under a creative commons attribution-noncommercial (?:[1-4]\.[05]|international|unported)
[cc-by-nc-sa]
this work is licensed under a creative commons attribution-noncommercial-sharealike
[cc-by-nc-nd]
this work is licensed under a creative commons attribution-noncommercial-noderiv
[odbl-1.0]
is a licen[cs]e agreement intended to allow users to freely share, modify, and use this database while maintaining this same freedom for others
if you publicly use any adapted version of this database
this .{1,80} is made available under the open database licen[cs]e
[odc-by-1.0]
which is made available under the odc attribution licen[cs]e
[pddl-1.0]
is a document intended to allow you to freely share, modify, and use this work for any purpose and without any restrictions
[cdla]
community data licen[cs]e agreement .{0,4}(?:permissive|sharing)
[ogl-uk]
contains public sector information licensed under the open government licen[cs]e
you are encouraged to use and re-use the information that is available under this licen[cs]e freely and flexibly
[etalab-2.0]
licence ouverte\s*/\s*open licen[cs]e
[dl-de]
datenlizenz deutschland
[openrail]
use-based restrictions as referenced in paragraph 5
you agree not to use the model or derivatives of the model
[llama]
llama [0-9.]{1,4} is licensed under the llama [0-9.]{1,4} community licen[cs]e
monthly active users of the products or services made available by or for licensee
[gemma]
gemma is provided under and subject to the gemma terms of use
[vim]
there are no restrictions on distributing unmodified copies of vim
vim is charityware
[w3c]
by obtaining(?:, using)? and/or copying this work, you .{0,20}the licensee.{0,20}agree that you have read, understood, and will comply
the name and trademarks of copyright holders may not be used in advertising or publicity pertaining to
[unicode]
to any person obtaining a copy of (?:the unicode )?data files and any associated documentation
in no event shall the copyright holder or holders included in this notice be liable for any claim, or any special indirect or consequential damages
[lppl-1.3c]
this work may be distributed and/or modified under the conditions of the latex project public licen[cs]e
this work has the lppl maintenance status
[qpl-1.0]
you may copy and distribute the software in unmodified form provided that the entire package
[ecl-2.0]
licensed under the educational community licen[cs]e
[cpal-1.0]
the contents of this file are subject to the common public attribution licen[cs]e
[rpl-1.5]
the contents of this file are subject to the reciprocal public licen[cs]e
[sissl]
the contents of this file are subject to the sun industry standards source licen[cs]e
[nasa-1.3]
government of the united states.{0,80}as represented by the administrator of the national aeronautics and space administration
[hippocratic]
the software may not be used by individuals, corporations, governments, or other groups for systems or activities that actively and knowingly endanger
[fal-1.3]
copyleft: this (?:is a free work|work of art is free), you can (?:copy, distribute|redistribute)
[public-domain]
this (?:file|work|code|software|document) (?:is|has been placed|was placed|is hereby placed) in the public domain
the author disclaims copyright to this source code
is a work of the u(?:nited states|\.s\.) government
not subject to copyright protection in the united states
[proprietary]
all rights reserved
this software is the confidential and proprietary information of
you shall not disclose such confidential information
no part of this (?:publication|software|document|book|work) may be reproduced
you may not reverse engineer, decompile,? or disassemble
this software is licensed, not sold
you agree to be bound by the terms of this (?:agreement|eula|licen[cs]e)
contains (?:trade secrets|proprietary information) of
may not be copied, distributed or modified without prior written (?:consent|permission)
the receipt or possession of this source code .{0,40}does not convey any rights
"""


def phrases() -> list[tuple[str, str]]:
    """(label, regex) in the order written."""
    label, out = "", []
    for line in filter(None, _TEXT.split("\n")):
        if line.startswith("["):
            label = line[1:-1]
        else:
            out.append((label, line))
    return out


#: A group, a class, an escaped or any character with what may follow it, and other marks: what a match need not hold as written.
_LOOSE = re.compile(r"\((?:\?<?[:!=])?[^()]*\)[?*]?|\[[^\]]*\](?:\{[^}]*\}|[?*+])?|\\[a-z](?:[?*+])?|\\?[^ ]\?|\.(?:\{[^}]*\}|[*+])?|[|*+^$]")


def stretches(regex: str) -> list[str]:
    """Texts that every match of a phrase holds (with single blanks)."""
    return [s for x in _LOOSE.sub("\0", re.sub(r"\\([^a-z])(?!\?)", lambda m: m[1] if m[1] not in ".()" else f"\\{m[1]}", regex)).replace("\\", "\0").split("\0") if (s := x.strip())]


def keyword(regex: str) -> str:
    """The longest of them."""
    return max(stretches(regex), key=len)

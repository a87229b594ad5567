"""Licence notices that the classifier of operator 9 learns from, and those that calibrate it.

Fixed values: public notices as their licences word them, the names that licences go by, and sentences around a name. No
sentence of the form in which the test tables cite licences is among them.
"""

from __future__ import annotations

#: Names of each family.
NAMES = {
    "AGPL": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL-3.0-or-later", "GNU AGPLv3", "Affero GPL"],
    "Apache": ["Apache License", "Apache License 2.0", "Apache-2.0", "Apache Software License, Version 2.0", "Apache 2.0 license", "ASL 2.0"],
    "BSD": ["BSD License", "BSD 3-Clause License", "BSD-3-Clause", "New BSD License", "2-clause BSD license", "BSD-2-Clause", "Modified BSD License", "BSD 3-Clause"],
    "CC-BY": ["Creative Commons Attribution License", "Creative Commons Attribution 4.0 International", "CC BY 4.0", "CC-BY-4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial License", "Creative Commons Attribution-NonCommercial 4.0 International", "CC BY-NC", "CC-BY-NC-4.0", "CC BY-NC 3.0", "CC BY-NC 4.0 International"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike License", "Creative Commons Attribution-ShareAlike 4.0 International", "CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA 3.0"],
    "CC0": ["CC0 1.0 Universal", "CC0-1.0", "Creative Commons Zero", "CC0 Public Domain Dedication", "Creative Commons CC0"],
    "GPL": ["GNU General Public License", "GNU GPL", "GPL-3.0-or-later", "GPL-2.0-only", "GNU General Public License v2", "GNU General Public License version 3 or later", "GPLv3", "GPLv2"],
    "ISC": ["ISC License", "ISC", "Internet Systems Consortium license", "ISC licence"],
    "LGPL": ["GNU Lesser General Public License", "GNU LGPL", "LGPL-2.1-or-later", "LGPL-3.0-only", "GNU Lesser General Public License, version 2.1", "LGPLv3", "GNU Library General Public License"],
    "MIT": ["MIT License", "MIT", "MIT licence", "Expat License", "MIT/Expat license", "MIT open source license"],
    "MPL": ["Mozilla Public License", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0", "Mozilla Public License, version 1.1"],
    "Unlicense": ["Unlicense", "The Unlicense", "Unlicense License"],
}
#: Names of licences of other families: those that the class unknown learns from, and those that the threshold is set on.
OTHER_NAMES = [
    "Artistic License 2.0", "Eclipse Public License", "zlib License", "Boost Software License 1.0", "Python Software Foundation License", "Academic Free License", "Open Font License", "Harbour License",
    "Quartz Public License, Version 4", "Northwind Source License", "Zope Public License", "Community Terms", "EPL-2.0", "BSL-1.0", "General Source Agreement", "W3C Software Notice", "custom license", "Lakeside Licence, version 3",
    "Brick Software License, Version 2.0", "Q Public License 1.0", "Sun Industry Standards Source License", "Open License 4.0", "Meridian Free Documentation License", "partner license", "Ruby License", "Delta Public License version 3",
    "Quartz", "ZQL-2.1", "NWSL 1.3", "Lakeside", "HPL-4", "Brook terms", "Ferry 2.0", "OSX-1.2",
]
HELD_OTHER_NAMES = [
    "European Union Public Licence", "Common Development and Distribution License", "Microsoft Public License", "Elastic License 2.0", "Server Side Public License", "Vim License", "Sleepycat License", "Quokka License",
    "Orchard Public License, Version 9", "Nethack General Public License", "house license", "Pine Software License 2.0", "CDDL-1.0", "EUPL-1.1", "Lantern Licence", "Ibex Source License version 3",
]
#: Sentences around a name; the last ones only calibrate.
FRAMES = [
    "{}", "SPDX-License-Identifier: {}", "License: {}", "This project is available under the {}", "Code in this repository is covered by the {}.", "Distributed under the terms of the {}.", "See the {} for details.",
    "The source code is licensed under {}", "Published under the {}, see the LICENSE file.", "You may use this file under the terms of the {}.", "This program is subject to the terms of the {}; see COPYING.", "The {} applies to all files here.",
    "Copyright (c) 2019 The Authors. Licensed under the {}.", "Use of this work is governed by the {}.", "Licensed under the {} by its authors", "Licensed under {} only", "Except where noted, content on this site is licensed under a {} license.", "This software is free, under the {}",
]
HELD_FRAMES = ["Contributions are accepted under the {}.", "This file is part of the library and is licensed to you under {}.", "All text is made available under {}", "// license {}"]
#: Whole notices of each family.
NOTICES = {
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "Apache": [
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    ],
    "CC-BY": [
        "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
        "This is an open access article distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, distribution, and reproduction in any medium, provided the original author and source are credited.",
    ],
    "CC-BY-NC": [
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
        "This is an open access article distributed under the Creative Commons Attribution-NonCommercial License, which permits use, distribution and reproduction in any medium for non-commercial purposes, provided the original work is properly cited.",
    ],
    "CC-BY-SA": [
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply. If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, CC0 1.0 Universal.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation.",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. For more information, please refer to <http://unlicense.org/>",
    ],
    "proprietary": [
        "Copyright 2021 Example Corporation, all rights reserved worldwide. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "No part of this publication may be reproduced, stored in a retrieval system, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "(c) 2015 Some Holder, all rights reserved", "All rights are reserved by the copyright holder.", "All rights are reserved.", "© 2020 Company Inc. All Rights Reserved Worldwide", "All content copyright of its owner, all rights reserved, reproduction prohibited",
        "This document contains confidential and proprietary information and may not be copied, distributed or disclosed without written permission.",
    ],
}
#: Whole notices that only calibrate.
HELD_NOTICES = {
    "Apache": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "BSD": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "CC-BY": ["Images are licensed under the Creative Commons Attribution 2.0 Generic license; you are free to share and adapt them with credit to the author."],
    "CC-BY-NC": ["Teaching notes, Creative Commons BY-NC, for non-commercial use with attribution"],
    "CC-BY-SA": ["Permission is granted to copy and share under the Creative Commons Attribution Share Alike license"],
    "CC0": ["No rights reserved: this dataset is in the public domain by CC0 1.0"],
    "GPL": ["Foobar is distributed in the hope that it will be useful, under the GNU General Public License; see the GNU GPL for more details."],
    "LGPL": ["The library may be linked with under the GNU Lesser General Public License; version 3 of the LGPL applies."],
    "MIT": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."],
    "MPL": ["This file is under the Mozilla Public License; you can obtain a copy of the MPL at mozilla.org"],
    "proprietary": ["All rights reserved by the publisher. Reproduction in whole or in part without written permission is prohibited."],
}
#: Whole notices of other families: for the class unknown, and for the threshold.
OTHER_NOTICES = [
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License which accompanies this distribution.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "By using this software you agree to the terms of the end user license agreement of the vendor.",
    "This package may be used and distributed under terms of our own making, see the file for the license.",
    "Permission is granted for internal use within the member's organisation, under the community agreement.",
    "The author makes no warranty. You may copy this package for educational purposes; commercial use requires a licence from the author.",
]
HELD_OTHER_NOTICES = [
    "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License.",
    "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software.",
    "You may distribute copies of this editor under the restrictions that its charityware licence states.",
]
